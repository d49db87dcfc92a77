"""Binary planes, forged bytes and exact detection against plain Python."""

import math

import duckdb
from pyspark.sql import functions as F

from fathom.functions import scalars
from fathom.operators import planes
from fathom.plans import catalog, registry

from .conftest import canonical


def test_frames_are_cut_by_offset(spark):
    rows = [(1, bytes(range(24)), 0.0), (1, bytes(range(24)), 0.5), (1, bytes(range(24)), 1.0), (1, bytes(range(24)), 7.0), (1, bytes(range(24)), -3.0)]
    df = spark.createDataFrame([(k, bytearray(b), f) for k, b, f in rows], "k int, b binary, f double")
    got = df.select("f", planes.pixels_at(F.col("b"), scalars.frame_index(F.col("f"), planes.frame_count(F.col("b"), 3, 2)), 3, 2).alias("p")).collect()
    assert {r.f: r.p[0] for r in got} == {0.0: 0.0, 0.5: 12.0, 1.0: 18.0, 7.0: 18.0, -3.0: 0.0} and all(len(r.p) == 6 for r in got)


def test_refused_planes_have_no_score(spark):
    good, other = bytearray(range(64)) * 2, bytearray(range(64, 128)) * 2
    rows = [(1, good, good, [0.1, 0.9]), (2, good[:-1], good, [0.1]), (3, bytearray(), good, [0.1]), (4, good, None, [0.1]), (5, good, good, []), (6, good, good[:64] + other[:64], [0.1, 0.9]), (7, good, good, None)]
    got = {r.segment: (r.frames, r.error, r.worst) for r in planes.sampled_scores(spark.createDataFrame(rows, "segment long, sent binary, reference binary, fractions array<double>"), 8, 8).collect()}
    assert got[1] == (2, None, 1.0) and got[6][2] < 0.9
    assert [got[k][1:] for k in (2, 3, 4, 5, 7)] == [("FrameSize", None)] * 5


def test_flipped(spark):
    df = spark.createDataFrame([(bytearray(b"abc"), 0), (bytearray(b"abc"), 2), (bytearray(b""), 0), (bytearray(b"\xff"), 0)], "b binary, k int")
    got = [bytes(r[0]) for r in df.select(planes.flipped(F.col("b"), F.col("k"))).collect()]
    assert got == [bytes([97 ^ 255]) + b"bc", b"ab" + bytes([99 ^ 255]), b"", b"\x00"]
    assert bytes(spark.sql("select array(0d, 15d, 255d) as a").select(planes.packed(F.col("a"))).first()[0]) == b"\x00\x0f\xff"


def test_exact_detection(spark):
    rows = [(n, m, k, far) for n in (1, 5, 12, 400) for m in (0, 1, 3, n) for k in (0, 1, 4, n) for far in (0.0, 0.3, 1.0) if m <= n and k <= n]
    got = spark.createDataFrame(rows, "n long, m long, k long, far double").select("*", scalars.detect_exactly(F.col("n"), F.col("m"), F.col("k"), F.col("far")).alias("p")).collect()
    for r in got:
        mass = [math.comb(r.m, j) * math.comb(r.n - r.m, r.k - j) / math.comb(r.n, r.k) for j in range(min(r.m, r.k) + 1)]
        assert abs(r.p - (1 - sum(p * r.far**j for j, p in enumerate(mass)))) < 1e-9
    huge = spark.sql("select 100000L as n, 50000L as m, 20000L as k, 0.999d as far").select(scalars.detect_exactly(F.col("n"), F.col("m"), F.col("k"), F.col("far"))).first()[0]
    assert 0.99995 < huge <= 1


def test_planes_without_all_their_quarters_agree_with_sql(spark, tmp_path):
    """Quarters missing at the end, within and on one side only; ids twice; ids below 0; vectors null, short, long and with odd values."""
    vector = lambda k: [math.sin(k * 1.7 + i * (0.3 + k % 5)) for i in range(64)]
    rows = [(k, vector(k)) for k in range(-9, 47) if k not in (9, 16, 17, 18, 24, 25, 26, 27, 33)]
    rows += [(5, vector(50)), (5, vector(51)), (8, vector(52)), (60, vector(60)), (65, vector(65)), (None, vector(70))]
    rows += [(80, None), (81, vector(81)[:60]), (82, vector(82) * 2), (83, [None, math.nan, math.inf, -math.inf] + vector(83)[4:]), (84, vector(84)), (85, []), (86, vector(86)), (87, vector(87))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = registry.mssim_planes(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    ran = con.execute(catalog.SQL["mssim_planes"])
    want = canonical([c[0] for c in ran.description], ran.fetchall())
    assert canonical(df.columns, df.collect()) == want
    assert {4, 9} < {r[want[0].index("windows")] for r in want[1]}
