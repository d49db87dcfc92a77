"""Scalar rules of queueing, sizing, sampling, detection and addressing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EWMA_ALPHA = 0.3
AGING_INTERVAL = 1000
SERVICE_SECONDS = 0.099
HEADROOM = 1
GLOBAL_FACTOR = 4
U32_MAX = 4294967295
ZERO_ROOT = "00" * 32


def next_epoch(epoch: Column) -> Column:
    return epoch + 1


def ewma(previous: Column, value: Column, alpha: float = EWMA_ALPHA) -> Column:
    return F.lit(alpha) * value + F.lit(1 - alpha) * previous


def ewma_series(values: Column, alpha: float = EWMA_ALPHA) -> Column:
    """Last value of the moving average over an ordered array, started at 0."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: ewma(a, x, alpha))


def aged_priority(base: Column, enqueued: Column, now: Column, interval: int = AGING_INTERVAL) -> Column:
    if interval == 0:
        return base
    return base + F.floor(F.greatest(now - enqueued, F.lit(0).cast("long")) / interval)


def positive_ceil(x: Column) -> Column:
    """Ceiling, at least 1 and at most 2**32 - 1; what is no finite number gives 1."""
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, F.lit(1).cast("long")).otherwise(F.least(F.lit(U32_MAX), F.greatest(F.lit(1).cast("long"), F.ceil(x))))


def in_flight_target(rate: Column, service: Column) -> Column:
    return rate * service


def worker_cap(target: Column, workers: Column) -> Column:
    return positive_ceil(target / F.greatest(workers, F.lit(1))) + HEADROOM


def queue_cap(target: Column) -> Column:
    return positive_ceil(target) * GLOBAL_FACTOR


def expired(now: Column, deadline: Column) -> Column:
    return now >= deadline


def survival(n: Column, tampered: Column, k: Column) -> Column:
    """Chance that k of n drawn without replacement miss all tampered ones."""
    steps = F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.greatest(F.lit(0.0), F.aggregate(steps, F.lit(1.0), lambda a, i: a * ((n - tampered - i) / (n - i).cast("double"))))


def detect_hypergeometric(n: Column, tampered: Column, k: Column) -> Column:
    none = (n == 0) | (tampered == 0) | (k == 0)
    return F.when(none, F.lit(0.0)).otherwise(1 - survival(n, tampered, k))


def detect_exactly(n: Column, tampered: Column, k: Column, passed: Column) -> Column:
    """Chance that one of k drawn of n is caught, where each tampered one drawn passes with chance ``passed`` on its own.

    1 - sum over j of P(j drawn are tampered) * passed**j; the hypergeometric mass
    by its recurrence, scaled down where it grows large, and divided by its sum.
    """
    least, most = F.greatest(F.lit(0).cast("long"), k - (n - tampered)), F.least(tampered, k)
    steps = F.when(most > least, F.sequence(least, most - 1)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("mass"), F.lit(1.0).alias("total"), F.pow(passed, least).alias("missed"))

    def after(a: Column, j: Column) -> Column:
        mass = a["mass"] * ((tampered - j) * (k - j)).cast("double") / ((j + 1) * (n - tampered - k + j + 1)).cast("double")
        scale = F.when(mass > 1e200, F.lit(1e-200)).otherwise(F.lit(1.0))
        return F.struct((mass * scale).alias("mass"), ((a["total"] + mass) * scale).alias("total"), ((a["missed"] + mass * F.pow(passed, j + 1)) * scale).alias("missed"))

    return F.when((n == 0) | (tampered == 0) | (k == 0), F.lit(0.0)).otherwise(1 - F.aggregate(steps, start, after, lambda a: a["missed"] / a["total"]))


def detect_binomial(share: Column, tampered: Column) -> Column:
    return 1 - F.pow(1 - share, tampered)


def uniform(key: Column) -> Column:
    """A reproducible number in [0, 1) from a string key."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / float(2**52)


def content_address(payload: Column) -> Column:
    """Leading 128 bits of the SHA-256, as hex."""
    return F.substring(F.sha2(payload, 256), 1, 32)


def leaf_hash(leaf: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("00")), leaf), 256))


def node_hash(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("01")), left, right), 256))


def commitment_of_one(payload: Column) -> Column:
    """The root over the single leaf sha256(payload), as hex."""
    return F.lower(F.hex(leaf_hash(F.unhex(F.sha2(payload, 256)))))


def wide(level: Column) -> Column:
    """A level of nodes padded with zero nodes to the next power of two."""
    size = F.size(level)
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(size, F.lit(1))))).cast("int")
    return F.concat(level, F.array_repeat(F.unhex(F.lit(ZERO_ROOT)), width - size))


def parent_level(level: Column) -> Column:
    half = F.sequence(F.lit(0), (F.size(level) / 2).cast("int") - 1)
    return F.transform(half, lambda i: node_hash(F.get(level, 2 * i), F.get(level, 2 * i + 1)))


def merkle_levels(leaves: Column) -> Column:
    """All levels from the padded hashed leaves to the root, for an array of binary leaves."""
    return node_levels(wide(F.transform(leaves, leaf_hash)))


def node_levels(base: Column) -> Column:
    """All levels from nodes, as many as a power of two, to the root."""
    depth = F.log2(F.size(base)).cast("int")
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(base), lambda acc, _: F.concat(acc, F.array(parent_level(F.element_at(acc, -1)))))


def merkle_root(leaves: Column) -> Column:
    """Hex root; no leaves give the zero root."""
    return F.when(F.size(leaves) == 0, F.lit(ZERO_ROOT)).otherwise(F.lower(F.hex(F.get(F.element_at(merkle_levels(leaves), -1), F.lit(0)))))


def merkle_proof(levels: Column, index: Column) -> Column:
    """Sibling nodes from leaf to root; null if the index is beyond the padded leaves."""
    inner = F.slice(levels, F.lit(1), F.size(levels) - 1)
    path = F.transform(inner, lambda level, d: F.get(level, F.floor(index / F.pow(F.lit(2.0), d)).cast("int").bitwiseXOR(F.lit(1))))
    return F.when((index >= 0) & (index < F.size(F.get(levels, F.lit(0)))), path)


def proof_holds(root: Column, leaf: Column, index: Column, proof: Column) -> Column:
    """Whether the proof leads from the leaf to the hex root and uses up all bits of the index."""
    start = F.struct(leaf_hash(leaf).alias("h"), index.cast("long").alias("i"))
    step = lambda a, s: F.struct(F.when(a.i % 2 == 0, node_hash(a.h, s)).otherwise(node_hash(s, a.h)).alias("h"), F.floor(a.i / 2).alias("i"))
    end = F.aggregate(proof, start, step)
    return (F.lower(F.hex(end.h)) == root) & (end.i == 0)


def associated_data(job: Column, segment: Column, role: Column) -> Column:
    """job and segment as 8 little-endian bytes each, then one byte of role."""

    return F.unhex(F.concat(_little_hex(job), _little_hex(segment), F.lpad(F.hex(role), 2, "0")))


def _little_hex(x: Column) -> Column:
    """The 8 bytes of a bigint, least first, as hex."""
    digits = F.lpad(F.hex(x), 16, "0")
    return F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(8)))


def cpu_list(text: Column) -> Column:
    """Sorted distinct ids of a list such as 0-3,8; other parts and falling ranges are skipped."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(\s*-\s*\d+)?$"))
    end = lambda p, k: F.trim(F.split_part(p, F.lit("-"), F.lit(k))).cast("int")
    ranges = F.transform(parts, lambda p: F.when(end(p, 1) <= end(p, -1), F.sequence(end(p, 1), end(p, -1))).otherwise(F.array().cast("array<int>")))
    return F.array_sort(F.array_distinct(F.flatten(ranges)))


def seal(payload: Column, key: Column, aad: Column, nonce: Column | None = None) -> Column:
    """nonce, ciphertext and tag under AES-256-GCM; without a nonce one is drawn."""
    return F.aes_encrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), nonce if nonce is not None else F.lit("").cast("binary"), aad)


def unseal(sealed: Column, key: Column, aad: Column) -> Column:
    """The payload, or null if too short to be sealed bytes or if anything was changed."""
    return F.when(F.length(sealed) >= 28, F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad))


def frame_index(fraction: Column, n: Column) -> Column:
    """The frame at a fraction (held within 0 and 1) of n frames."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))
    return F.least(F.floor(held * n).cast("bigint"), n.cast("bigint") - 1)


def challenge_seed(commitment_hex: Column, nonce: Column) -> Column:
    """The first 8 bytes, little-endian and unsigned, of SHA-256 over a commitment and 16 little-endian bytes of a number, as a decimal."""
    raw = F.concat(F.unhex(commitment_hex), F.unhex(F.concat(_little_hex(nonce), F.lit("00" * 8))))
    digest = F.sha2(raw, 256)
    turned = F.concat(*(F.substring(digest, 15 - 2 * k, 2) for k in range(8)))
    return F.conv(turned, 16, 10)


def window_times(window: Column, seconds: float = 4.0, windows: int = 4) -> Column:
    """The two sampled times of a window, 15 and 55 % into it."""
    size = seconds / windows
    return F.array(window * size + 0.15 * size, window * size + 0.55 * size)


def parts_per_million(part: Column, whole: Column) -> Column:
    """part * 1000000 div whole, 0 of nothing."""
    share = F.floor(part.cast("decimal(20,0)") * 1000000 / F.nullif(whole, F.lit(0)).cast("decimal(20,0)")).cast("bigint")
    return F.when(whole > 0, share).otherwise(F.lit(0).cast("bigint"))


#: Encoders by codec, muxers by container.
ENCODERS = {"H264": "libx264", "H265": "libx265", "Av1": "libsvtav1", "Vp9": "libvpx-vp9"}
MUXERS = {"Mp4": "mp4", "WebM": "webm", "Mkv": "matroska", "MpegTs": "mpegts"}


def _named(key: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)


def encoder_of(codec: Column) -> Column:
    return _named(codec, ENCODERS)


def muxer_of(container: Column) -> Column:
    return _named(container, MUXERS)


def catch_detail(attack: Column) -> Column:
    """What a caught attack is: changed bytes break the commitment, anything else lowers fidelity."""
    return F.when(attack == "byte_swap", "CommitmentMismatch").otherwise("FidelityBelowThreshold")
