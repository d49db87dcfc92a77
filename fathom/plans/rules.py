"""The lifecycle transition rules, stated once as expressions over a state s and an event e.

Order of evaluation: terminal states, kind of event, state, epoch, holder. A Tick
is no event of the task but the clock (in ``deadline``) as it meets the task: it
ends a lease whose deadline it has reached and is never rejected.
"""

#: Fixed value: failed verifications that put a task back before it fails for good.
MAX_RETRIES = 3
FIELDS = ("status", "holder", "epoch", "deadline", "epoch_hw", "retries")

ERROR = """CASE
 WHEN e.event = 'Tick' THEN NULL
 WHEN s.status IN ('Accepted', 'Failed') THEN 'Terminal'
 WHEN e.event = 'Abandon' THEN NULL
 WHEN e.event = 'Lease' THEN CASE WHEN s.status <> 'Pending' THEN 'IllegalTransition' WHEN e.epoch <= s.epoch_hw THEN 'StaleEpoch' END
 WHEN e.event IN ('Heartbeat', 'Submit') THEN CASE WHEN s.status <> 'Leased' THEN 'IllegalTransition' WHEN e.epoch <> s.epoch THEN 'StaleEpoch' WHEN e.worker <> s.holder THEN 'WrongHolder' END
 WHEN e.event IN ('SelectForVerification', 'Accept') THEN CASE WHEN s.status <> 'Submitted' THEN 'IllegalTransition' END
 WHEN e.event = 'VerifyOutcome' THEN CASE WHEN s.status <> 'Verifying' THEN 'IllegalTransition' END
 WHEN e.event = 'LeaseExpired' THEN CASE WHEN s.status = 'Submitted' THEN NULL WHEN s.status <> 'Leased' THEN 'IllegalTransition' WHEN e.epoch <> s.epoch THEN 'StaleEpoch' END
 ELSE 'IllegalTransition' END"""

LAPSED = "e.event = 'Tick' AND s.status = 'Leased' AND s.deadline <= e.deadline"
STATUS = f"""CASE
 WHEN {LAPSED} THEN 'Pending'
 WHEN e.event = 'Tick' THEN s.status
 WHEN ({ERROR}) IS NOT NULL THEN s.status
 WHEN e.event = 'Abandon' THEN 'Failed'
 WHEN e.event = 'Lease' THEN 'Leased'
 WHEN e.event = 'Heartbeat' THEN 'Leased'
 WHEN e.event = 'Submit' THEN 'Submitted'
 WHEN e.event = 'SelectForVerification' THEN 'Verifying'
 WHEN e.event = 'Accept' THEN 'Accepted'
 WHEN e.event = 'VerifyOutcome' THEN CASE WHEN e.passed THEN 'Accepted' WHEN s.retries < {MAX_RETRIES} THEN 'Pending' ELSE 'Failed' END
 WHEN s.status = 'Leased' THEN 'Pending'
 ELSE s.status END"""

_OK = f"({ERROR}) IS NULL"
HOLDER = f"CASE WHEN {_OK} AND e.event = 'Lease' THEN e.worker ELSE s.holder END"
EPOCH = f"CASE WHEN {_OK} AND e.event = 'Lease' THEN e.epoch ELSE s.epoch END"
DEADLINE = f"CASE WHEN {_OK} AND e.event IN ('Lease', 'Heartbeat') THEN e.deadline ELSE s.deadline END"
EPOCH_HW = f"CASE WHEN {_OK} AND e.event = 'Lease' THEN e.epoch ELSE s.epoch_hw END"
RETRIES = f"CASE WHEN {_OK} AND e.event = 'VerifyOutcome' AND NOT e.passed AND s.retries < {MAX_RETRIES} THEN s.retries + 1 ELSE s.retries END"
ACTIONS = f"""CASE
 WHEN {LAPSED} THEN 'Requeue,EmitReputation(Timeout)'
 WHEN e.event = 'Tick' THEN ''
 WHEN ({ERROR}) IS NOT NULL THEN ''
 WHEN e.event = 'Abandon' THEN 'MarkFailed'
 WHEN e.event = 'SelectForVerification' THEN 'IssueChallenge'
 WHEN e.event = 'Accept' OR (e.event = 'VerifyOutcome' AND e.passed) THEN 'NotifyAccepted'
 WHEN e.event = 'VerifyOutcome' AND s.retries < {MAX_RETRIES} THEN 'Requeue,EmitReputation(VerificationFailure)'
 WHEN e.event = 'VerifyOutcome' THEN 'MarkFailed,EmitReputation(VerificationFailure)'
 WHEN e.event = 'LeaseExpired' AND s.status = 'Leased' THEN 'Requeue,EmitReputation(Timeout)'
 ELSE '' END"""
NEXT = {"status": STATUS, "holder": HOLDER, "epoch": EPOCH, "deadline": DEADLINE, "epoch_hw": EPOCH_HW, "retries": RETRIES}
START = {"status": "'Pending'", "holder": "CAST(NULL AS BIGINT)", "epoch": "CAST(0 AS BIGINT)", "deadline": "CAST(0 AS BIGINT)", "epoch_hw": "CAST(0 AS BIGINT)", "retries": "CAST(0 AS BIGINT)"}
