"""SQL of the lifecycle fold, written from the transition table and not from the text that Spark evaluates.

The table is a relation: the fold joins each task's state with the rule for its
state and event, checks the rule's fence, and takes over what the rule names.
"""

from ..sources import tables as T

#: state, event, verdict that it takes, whether retries are spent, fence, next state, actions.
RULES = """rule(state, event, passed, spent, fence, next, actions) AS (VALUES
 ('Pending', 'Lease', NULL::BOOLEAN, NULL::BOOLEAN, 'mint', 'Leased', ''),
 ('Leased', 'Heartbeat', NULL, NULL, 'holder', 'Leased', ''),
 ('Leased', 'Submit', NULL, NULL, 'holder', 'Submitted', ''),
 ('Leased', 'LeaseExpired', NULL, NULL, 'epoch', 'Pending', 'Requeue,EmitReputation(Timeout)'),
 ('Leased', 'Tick', NULL, NULL, 'clock', 'Pending', 'Requeue,EmitReputation(Timeout)'),
 ('Submitted', 'SelectForVerification', NULL, NULL, 'none', 'Verifying', 'IssueChallenge'),
 ('Submitted', 'Accept', NULL, NULL, 'none', 'Accepted', 'NotifyAccepted'),
 ('Submitted', 'LeaseExpired', NULL, NULL, 'none', 'Submitted', ''),
 ('Verifying', 'VerifyOutcome', true, NULL, 'none', 'Accepted', 'NotifyAccepted'),
 ('Verifying', 'VerifyOutcome', false, false, 'none', 'Pending', 'Requeue,EmitReputation(VerificationFailure)'),
 ('Verifying', 'VerifyOutcome', false, true, 'none', 'Failed', 'MarkFailed,EmitReputation(VerificationFailure)'),
 ('Pending', 'Abandon', NULL, NULL, 'none', 'Failed', 'MarkFailed'),
 ('Leased', 'Abandon', NULL, NULL, 'none', 'Failed', 'MarkFailed'),
 ('Submitted', 'Abandon', NULL, NULL, 'none', 'Failed', 'MarkFailed'),
 ('Verifying', 'Abandon', NULL, NULL, 'none', 'Failed', 'MarkFailed'))"""

_JUDGED = """SELECT e.task, e.rn, e.seq, e.event, e.worker, e.epoch AS given, e.deadline AS due, f.status AS was, f.holder, f.epoch, f.deadline, f.epoch_hw, f.retries, r.next, r.fence, r.passed, r.spent, r.actions,
  CASE WHEN f.status = 'Accepted' OR f.status = 'Failed' THEN 'Terminal'
       WHEN r.next IS NULL THEN 'IllegalTransition'
       WHEN r.fence = 'mint' AND NOT e.epoch > f.epoch_hw THEN 'StaleEpoch'
       WHEN r.fence IN ('epoch', 'holder') AND NOT e.epoch = f.epoch THEN 'StaleEpoch'
       WHEN r.fence = 'holder' AND NOT e.worker = f.holder THEN 'WrongHolder' END AS error
 FROM f JOIN n e ON e.task = f.task AND e.rn = f.rn + 1
 LEFT JOIN rule r ON r.state = f.status AND r.event = e.event AND coalesce(r.passed = e.passed, true) AND coalesce(r.spent = (f.retries = 3), true) AND (r.fence <> 'clock' OR e.deadline >= f.deadline)"""


def fold(events: str) -> str:
    """f has a row per task and event number (0 before the first) with the state after it; to stand behind WITH RECURSIVE."""
    return f"""ev AS ({events}), n AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY seq) AS rn FROM ev), {RULES},
f AS (SELECT task, 0::BIGINT AS rn, 0::BIGINT AS seq, '' AS event, '' AS was, 'Pending' AS status, NULL::BIGINT AS holder, 0::BIGINT AS epoch, 0::BIGINT AS deadline, 0::BIGINT AS epoch_hw, 0::BIGINT AS retries,
  NULL::VARCHAR AS error, '' AS actions FROM (SELECT DISTINCT task FROM n)
 UNION ALL SELECT task, rn, seq, event, was, CASE WHEN error IS NULL THEN next ELSE was END,
  CASE WHEN error IS NULL AND fence = 'mint' THEN worker ELSE holder END, CASE WHEN error IS NULL AND fence = 'mint' THEN given ELSE epoch END,
  CASE WHEN error IS NULL AND (fence = 'mint' OR event = 'Heartbeat') THEN due ELSE deadline END, CASE WHEN error IS NULL AND fence = 'mint' THEN given ELSE epoch_hw END,
  retries + CASE WHEN error IS NULL AND spent = false THEN 1 ELSE 0 END, error, CASE WHEN error IS NULL THEN actions ELSE '' END FROM ({_JUDGED}))"""


FOLD = fold(T.TASK_EVENTS)
