"""Golden values: transitions, standings, Merkle trees, sealed bytes, similarity, detection, intervals, scalars."""

import hashlib
import itertools
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fathom.functions import reputation, scalars, udfs
from fathom.operators import analytics, commitments, exchange, lifecycle
from fathom.operators.ordered import in_order
from fathom.streaming import tasks

EVENTS = ("Lease", "Heartbeat", "Submit", "SelectForVerification", "Accept", "VerifyOutcome", "LeaseExpired", "Abandon")
STATES = ("Pending", "Leased", "Submitted", "Verifying", "Accepted", "Failed")
_SCHEMA = "task long, seq long, event string, worker long, epoch long, deadline long, passed boolean"
#: Events (event, worker, epoch, deadline, passed) that lead to each state; holder 1, epoch 1, deadline 100.
_LEASE, _SUBMIT, _SELECT = ("Lease", 1, 1, 100, False), ("Submit", 1, 1, 0, False), ("SelectForVerification", 0, 0, 0, False)
WAY = {"Pending": [], "Leased": [_LEASE], "Submitted": [_LEASE, _SUBMIT], "Verifying": [_LEASE, _SUBMIT, _SELECT], "Accepted": [_LEASE, _SUBMIT, ("Accept", 0, 0, 0, False)], "Failed": [("Abandon", 0, 0, 0, False)]}
#: (state, event, worker 1 or 2, epoch 0 to 2, passed) to (error, next state, actions); written out from the contract, everything else is illegal.
RIGHT = {("Pending", "Lease"): "Leased", ("Leased", "Heartbeat"): "Leased", ("Leased", "Submit"): "Submitted", ("Submitted", "SelectForVerification"): "Verifying", ("Submitted", "Accept"): "Accepted", ("Leased", "LeaseExpired"): "Pending", ("Submitted", "LeaseExpired"): "Submitted"}
DONE = {"SelectForVerification": "IssueChallenge", "Accept": "NotifyAccepted"}


def expected(state, event, worker, epoch, passed):
    if state in ("Accepted", "Failed"):
        return "Terminal", state, ""
    if event == "Abandon":
        return None, "Failed", "MarkFailed"
    if (state, event) == ("Verifying", "VerifyOutcome"):
        return (None, "Accepted", "NotifyAccepted") if passed else (None, "Pending", "Requeue,EmitReputation(VerificationFailure)")
    if (state, event) not in RIGHT:
        return "IllegalTransition", state, ""
    if event == "Lease" and epoch < 1 or state == "Leased" and epoch != 1:
        return "StaleEpoch", state, ""
    if state == "Leased" and event != "LeaseExpired" and worker != 1:
        return "WrongHolder", state, ""
    actions = "Requeue,EmitReputation(Timeout)" if (state, event) == ("Leased", "LeaseExpired") else DONE.get(event, "")
    return None, RIGHT[state, event], actions


def test_every_state_and_event(spark):
    """All states and events, with right and wrong epochs and holders, in the batch fold and in the stream's step."""
    cases = list(itertools.product(STATES, EVENTS, (1, 2), (0, 1, 2), (True, False)))
    rows = []
    for task, (state, *event) in enumerate(cases):
        steps = [*WAY[state], (event[0], event[1], event[2], 200, event[3])]
        rows += [(task, k, *s) for k, s in enumerate(steps)]
    got = {}
    for r in lifecycle.replay(spark.createDataFrame(rows, _SCHEMA)).collect():
        got[r.task] = max(got.get(r.task, r), r, key=lambda x: x.seq)
    for task, case in enumerate(cases):
        r = got[task]
        assert (r.error, r.status, r.actions) == expected(*case), case
        assert r.deadline == (200 if r.error is None and case[1] in ("Lease", "Heartbeat") else 100 if _LEASE in WAY[case[0]] else 0)
        state = tasks.START
        for s in WAY[case[0]]:
            state = tasks.advance(state, SimpleNamespace(**dict(zip(("event", "worker", "epoch", "deadline", "passed"), s, strict=True))))
        e = SimpleNamespace(event=case[1], worker=case[2], epoch=case[3], deadline=200, passed=case[4])
        error = tasks.rejection(state, e)
        after = state if error else tasks.advance(state, e)
        assert (error, *after) == (r.error, r.status, r.holder, r.epoch, r.deadline, r.epoch_hw, r.retries), case


def test_fourth_failed_verification_is_final(spark):
    rows, seq = [], itertools.count()
    for epoch in range(1, 5):
        rows += [(1, next(seq), *s) for s in (("Lease", 1, epoch, 9, False), ("Submit", 1, epoch, 0, False), _SELECT, ("VerifyOutcome", 0, 0, 0, False))]
    last = max(lifecycle.replay(spark.createDataFrame(rows, _SCHEMA)).collect(), key=lambda r: r.seq)
    assert (last.status, last.retries, last.actions) == ("Failed", 3, "MarkFailed,EmitReputation(VerificationFailure)")


def test_zombie_of_an_older_epoch(spark):
    rows = [(1, k, *s) for k, s in enumerate([_LEASE, ("LeaseExpired", 0, 1, 0, False), ("Lease", 2, 2, 200, False), _SUBMIT])]
    last = max(lifecycle.replay(spark.createDataFrame(rows, _SCHEMA)).collect(), key=lambda r: r.seq)
    assert (last.error, last.status, last.holder) == ("StaleEpoch", "Leased", 2)


def test_long_logs_fold_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "BLOCK", 3)
    rows = [(1, k, *s) for k, s in enumerate([_LEASE, ("Heartbeat", 1, 1, 150, False), ("Heartbeat", 2, 1, 160, False), _SUBMIT, _SELECT, ("VerifyOutcome", 0, 0, 0, True), _LEASE])]
    got = [(r.seq, r.was, r.status, r.error) for r in lifecycle.replay(spark.createDataFrame(rows, _SCHEMA)).orderBy("seq").collect()]
    assert got == [(0, "Pending", "Leased", None), (1, "Leased", "Leased", None), (2, "Leased", "Leased", "WrongHolder"), (3, "Leased", "Submitted", None), (4, "Submitted", "Verifying", None), (5, "Verifying", "Accepted", None), (6, "Accepted", "Accepted", "Terminal")]
    details = ["Ok", *["FidelityBelowThreshold"] * 4, *["Ok"] * 5, "CommitmentMismatch", "Inconclusive", *["IntegrityViolation"] * 3, "Ok"]
    standing, want = 0, []
    for k, d in enumerate(details):
        before, standing = standing, max(-128, min(0, standing + reputation.VERDICT_DELTAS[d]))
        want.append((1, k, d, before, standing))
    verdicts = spark.createDataFrame([(1, k, d) for k, d in enumerate(details)], "worker long, seq long, detail string").repartition(4)
    assert sorted(map(tuple, lifecycle.trajectories(verdicts).collect())) == want
    assert [tuple(r) for r in lifecycle.standings(verdicts).collect()] == [(1, len(details), standing)]


def test_standings_and_bands(spark):
    rows = [(0, 0), (-1, 1), (-8, 1), (-9, 2), (-31, 2), (-32, 3), (-63, 3), (-64, 4), (-128, 4)]
    assert all(r.standing_tier == r.tier for r in spark.createDataFrame(rows, "s int, tier int").withColumn("standing_tier", reputation.tier_of(F.col("s"))).collect())
    coarse = exchange.coarse_standings(spark.createDataFrame([(1, 1, "Timeout"), (1, 2, "VerificationFailure"), *[(2, k, "VerificationFailure") for k in range(40)]], "worker long, seq long, change string"))
    assert {tuple(r) for r in coarse.collect()} == {(1, -12), (2, -128)}
    assert spark.range(1).select(scalars.next_epoch(F.lit(3))).first()[0] == 4


#: Roots over leaves of byte i repeated 32 times.
ROOTS = {1: "7f9c9e31ac8256ca2f258583df262dbc7d6f68f2a03043d5c99a4ae5a7396ce9", 2: "28fb81e496897e0ce886f08602392e9239b65c659041e5202163e58ad898f444", 3: "8e712886ded4dfa7f65a931a13910aadc1cfc9f8665237fa9f46f3b35a2cc91b", 4: "fdea52008cdae79fa8bf806261959e23f5e11681646a2fa2bc9b5e56b32030a2", 5: "87c07e6f26d8f044e266efacaea06e008ea658c186c230bac5c6af71d4e4303e", 7: "00b941964cd2c52c72ea28dc3ff3589917255a83445cadd56e419de0f070b751", 8: "f907f23f76aa01b755a614d31ef9832909f44638b4590073301e61e6d01f9a1d"}


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_merkle_by_blocks(spark, monkeypatch, levels):
    """Roots, proofs and openings, whatever the size of the blocks."""
    monkeypatch.setattr(commitments, "LEVELS", levels)
    leaves = spark.createDataFrame([(n, i, bytearray([i] * 32)) for n in ROOTS for i in range(n)], "job long, at long, leaf binary").repartition(3)
    nodes = commitments.leaf_nodes(leaves, "at")
    assert {r.job: (r.leaves, r.root) for r in commitments.roots(nodes).collect()} == {n: (n, root) for n, root in ROOTS.items()}
    wanted = spark.createDataFrame([(n, i) for n in ROOTS for i in range(-1, n + 2)], "job long, index long")
    found = {(r.job, r["index"]): r.proof for r in commitments.proofs(nodes, wanted).collect()}
    for (n, i), proof in found.items():
        assert (proof is not None) == (0 <= i < n)
        if proof is not None:
            h, k = hashlib.sha256(b"\x00" + bytes([i] * 32)).digest(), i
            for s in proof:
                h = hashlib.sha256(b"\x01" + (h + bytes(s) if k % 2 == 0 else bytes(s) + h)).digest()
                k //= 2
            assert (h.hex(), k) == (ROOTS[n], 0)


def test_openings(spark):
    leaves = spark.createDataFrame([(n, i, bytearray([i] * 32)) for n in (4, 5) for i in range(n)], "job long, at long, leaf binary")
    nodes = commitments.leaf_nodes(leaves, "at")
    opened = commitments.openings(nodes, spark.createDataFrame([(5, 0), (5, 4), (5, 2), (4, 1), (4, 4)], "job long, index long"))
    rows = {r.job: r for r in opened.collect()}
    assert rows[4].leaves is None and rows[4].proofs is None and [x["index"] for x in rows[5].leaves] == [0, 2, 4]
    five = opened.where("job = 5")
    holds = lambda leaves="leaves", proofs="proofs", root=ROOTS[5]: five.select(commitments.reveal_holds(F.lit(root), F.expr(leaves), F.expr(proofs))).first()[0]
    assert holds() is True and holds(root=ROOTS[4]) is False
    assert holds("slice(leaves, 1, 0)", "slice(proofs, 1, 0)") is True
    assert holds("slice(leaves, 1, 2)") is False and holds("transform(leaves, x -> named_struct('index', x.index + 1, 'leaf', x.leaf))") is False
    assert holds(proofs="transform(proofs, p -> reverse(p))") is False


def test_no_leaves(spark):
    assert spark.range(1).select(scalars.merkle_root(F.array().cast("array<binary>"))).first()[0] == scalars.ZERO_ROOT
    assert commitments.roots(commitments.leaf_nodes(spark.createDataFrame([], "job long, at long, leaf binary"), "at")).isEmpty()


def test_address_of_a_blob(spark):
    one = spark.range(1).select(scalars.content_address(F.lit(bytearray(b"abc"))), scalars.commitment_of_one(F.lit(bytearray(b"abc")))).first()
    assert tuple(one) == ("ba7816bf8f01cfea414140de5dae2223", "8a7deab2cc5ee003b6394337538a52b3198f1a6ddeb10c7daf62fe1c9834b43b")


def test_associated_data(spark):
    aad = spark.range(1).select(F.lower(F.hex(scalars.associated_data(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"), F.lit(1))))).first()[0]
    assert aad == "0100000000000000" + "0200000000000000" + "01"


def test_sealed_bytes_of_a_published_vector(spark):
    """AES-256-GCM test case 16 of the algorithm's specification."""
    key, iv = "feffe9928665731c6d6a8f9467308308feffe9928665731c6d6a8f9467308308", "cafebabefacedbaddecaf888"
    plain = "d9313225f88406e5a55909c5aff5269a86a7a9531534f7da2e4c303d8a318a721c3c0c95956809532fcf0e2449a6b525b16aedf5aa0de657ba637b39"
    aad = "feedfacedeadbeeffeedfacedeadbeefabaddad2"
    cipher, tag = "522dc1f099567d07f47f37a32a84427d643a8cdcbfe5c0c97598a2bd2555d1aa8cb08e48590dbb3da7b08b1056828838c5f61e6393ba7a0abcc9f662", "76fc6ece0f4e1768cddf8853bb2d551b"
    x = lambda h: F.unhex(F.lit(h))
    sealed = spark.range(1).select(F.lower(F.hex(scalars.seal(x(plain), x(key), x(aad), x(iv)))).alias("s"), F.lower(F.hex(scalars.unseal(F.unhex(F.lit(iv + cipher + tag)), x(key), x(aad)))).alias("p")).first()
    assert (sealed.s, sealed.p) == (iv + cipher + tag, plain)
    drawn = spark.range(2).select(F.hex(scalars.seal(F.when(F.col("id") >= 0, x(plain)), x(key), x(aad))).alias("s")).collect()
    assert len({r.s for r in drawn}) == 2


def test_changed_bytes_never_open(spark):
    from fathom.plans import registry

    from .conftest import DATA

    rows = registry.aead_roundtrip(spark, DATA).collect()
    assert {(r.opened_by, r.well_formed) for r in rows} == {("opened", True)} and all(r.sealed_bytes >= 28 for r in rows)


def _plane(spark, a, b, w, h):
    return spark.createDataFrame([(1, w, h, [float(v) for v in a], [float(v) for v in b])], "id int, w int, h int, a array<double>, b array<double>")


def test_similarity_of_planes(spark):
    score = lambda a, b, w, h: analytics.mean_similarity(_plane(spark, a, b, w, h), "id").first()
    ramp = [(x * 7 + y * 13) % 256 for y in range(40) for x in range(40)]
    one = score(ramp, ramp, 40, 40)
    assert one.windows == 81 and abs(one.mssim - 1) < 1e-12
    assert score(ramp[:25], ramp[:25], 5, 5).windows == 1 and abs(score([9] * 64, [9] * 64, 8, 8).mssim - 1) < 1e-12
    noisy = lambda n: [max(0, min(255, v + (n if (k * 2654435761) % 7 < 3 else -n))) for k, v in enumerate(ramp)]
    assert 1 > score(ramp, noisy(10), 40, 40).mssim > score(ramp, noisy(40), 40, 40).mssim
    with pytest.raises(Exception, match="unequal size"):
        score([1] * 256, [1] * 512, 16, 16)


@pytest.mark.parametrize(("x", "n", "low", "high"), [(10, 48, 0.104691, 0.349910), (1, 12, 0.002108, 0.384796), (0, 10, 0, 0.30850), (10, 10, 0.69150, 1), (6, 9, 0.2993, 0.9251), (1, 4, 0.006309, 0.805880), (0, 0, 0, 1)])
def test_exact_intervals(x, n, low, high):
    got = udfs.interval(x, n)
    assert abs(got[0] - low) < 6e-5 and abs(got[1] - high) < 6e-5


def test_detection(spark):
    cases = [(4, 2, 1, 0.5), (4, 2, 2, 5 / 6), (8, 2, 2, 13 / 28), (4, 2, 3, 1.0), (8, 4, 0, 0.0)]
    rows = spark.createDataFrame(cases, "n long, m long, k long, p double").withColumn("got", scalars.detect_hypergeometric(F.col("n"), F.col("m"), F.col("k")))
    assert all(abs(r.got - r.p) < 1e-12 for r in rows.collect())


def test_challenges(spark):
    seeds = spark.createDataFrame([(0x5EED1234ABCD0001,), (0,)], "seed long").select(udfs.sample_fractions(3)("seed").alias("f")).collect()
    assert seeds[0].f == [0.3067128072149512, 0.3560392573367772, 0.8497188935603891] and seeds[1].f[:2] == [0.8833108082136426, 0.43152799704850997]
    frames = spark.createDataFrame([(-1.0, 4), (0.0, 4), (0.49, 4), (1.0, 4), (2.0, 4)], "f double, n int").select(scalars.frame_index(F.col("f"), F.col("n"))).collect()
    assert [r[0] for r in frames] == [0, 0, 1, 3, 3]
    want = int.from_bytes(hashlib.sha256(bytes(32) + (77).to_bytes(16, "little")).digest()[:8], "little")
    assert spark.range(1).select(scalars.challenge_seed(F.lit("00" * 32), F.lit(77).cast("bigint"))).first()[0] == str(want)


def test_numbers_that_are_no_numbers(spark):
    rows = [(None, 1), (float("nan"), 1), (float("inf"), 1), (-3.0, 1), (0.2, 1), (2.5, 3), (1e12, 4294967295)]
    assert all(r.got == r.want for r in spark.createDataFrame(rows, "x double, want long").withColumn("got", scalars.positive_ceil(F.col("x"))).collect())
    shares = [(float("nan"), 0), (-0.1, 0), (0.0, 0), (0.1, 1), (1.0, 8), (3.0, 8)]
    assert all(r.got == r.want for r in spark.createDataFrame(shares, "p double, want long").withColumn("got", reputation.challenge_count(F.col("p"), F.lit(8).cast("bigint"))).collect())
    lists = [("0-3,8", [0, 1, 2, 3, 8]), (" 2 , 1,1 - 2, x", [1, 2]), ("", []), ("5-3,4", [4])]
    assert [r.got for r in spark.createDataFrame(lists, "t string, want array<int>").withColumn("got", scalars.cpu_list(F.col("t"))).collect()] == [w for _, w in lists]
    assert [r[0] for r in spark.createDataFrame([(5, 10), (0, 0)], "a long, b long").select(scalars.parts_per_million(F.col("a"), F.col("b"))).collect()] == [500000, 0]


@pytest.mark.parametrize("range_rows", [1, 5, 1000])
def test_places_in_one_order(spark, range_rows):
    rows = [(k % 3, (k * 37) % 11, k, 1 + k % 4) for k in range(60)]
    got = in_order(spark.createDataFrame(rows, "key int, v int, id int, w int").repartition(5), "v", "id", keys=["key"], sums={"under": "w"}, range_rows=range_rows).collect()
    for key in range(3):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        want = {r[2]: (k, own[k - 1][1] if k else None, sum(x[3] for x in own[:k])) for k, r in enumerate(own)}
        assert {r.id: (r.place, r.previous, r.under) for r in got if r.key == key} == want
    assert in_order(spark.createDataFrame([], "v int"), "v").isEmpty()


def test_placement(spark):
    worker = lambda rows: analytics.least_loaded(spark.createDataFrame(rows, "worker long, in_flight long, ewma double, last_heartbeat long, tier int"), 100, 100, 2).first()[0]
    assert worker([(1, 1, 5.0, 90, 0), (2, 1, 9.0, 90, 0), (3, 1, 7.0, 90, 0)]) == 2
    assert worker([(1, 0, 1.0, 90, 3), (2, 0, 1.0, 90, 4), (3, 0, 1.0, -50, 0), (4, 2, 1.0, 90, 0), (5, 1, 1.0, 90, 1)]) == 5
    assert worker([(1, 2, 1.0, 90, 0)]) is None
    aged = spark.createDataFrame([(0, 0, 40, 4), (5, 40, 40, 5), (0, 0, 60, 6)], "base long, enqueued long, now long, want long").withColumn("got", scalars.aged_priority(F.col("base"), F.col("enqueued"), F.col("now"), 10))
    assert all(r.got == r.want for r in aged.collect())


def test_strict_candidates(spark):
    candidates, workers = spark.createDataFrame([(9, 0)], "worker long, tier int"), spark.createDataFrame([(1, 0, 0.0, 5)], "worker long, in_flight long, ewma double, last_heartbeat long")
    assert exchange.candidate_loads(candidates, workers).first().error == "UnknownWorker"
    with pytest.raises(Exception, match="unknown worker 9"):
        exchange.candidate_loads(candidates, workers, strict=True).collect()
