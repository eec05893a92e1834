"""Secrets in texts, judged by who else has them.

A task finds candidates: assignments to names such as password or token, access key ids, long hexadecimal strings, and, beyond these, private keys, logins
in addresses and mixed tokens.  Only a digest of a candidate's value leaves the task.  Over the whole corpus each digest has a number of distinct
repositories and owners: a value that many owners have is a copied example, one that its owner alone has (or a few repositories of few owners, such as
forks) and that looks random is a live credential.

Owners and repositories are counted in three steps (value, owner and repository; value and owner; value), each combined before its shuffle, and the counts
return to the documents by value and block of rows, so that a value which a third of all documents hold is one row for each block.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripline.llm.common import LOWER, flat, slices, width
from stripline.session import cut

# Kinds in the order of their names in a list of spans; names that secrets are assigned to; words of values that are no secrets.
KINDS = ("assign", "access", "hex", "key", "login", "token")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
PLACEHOLDERS = re.compile(rb"example|sample|changeme|placeholder|dummy|redacted|foobar|your[-_]?|xxxx|12345678|abcdefgh|(.)\1{5}", re.I)
BASE = 3  # kinds that are always spans

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEY = re.compile(rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----([A-Za-z0-9+/=\r\n\t ]*)(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?")
LOGIN = re.compile(rb"://([^\x00-\x20/:@\"'<>]+):([^\x00-\x20/@\"'<>]{3,})@")
LEAST = {"assign": 6, "access": 20, "hex": 24, "token": 20}
HEX, MIXED = np.zeros(256, bool), np.zeros(256, bool)
HEX[[*b"0123456789abcdef"]] = True
MIXED[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+=-"]] = True
CLASS = np.zeros(256, np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[48:58] = 1, 2, 3

MAX_OWNERS, MAX_REPOSITORIES = 2, 4
FOUND = "array<struct<start: bigint, kind: int, `end`: bigint, value: binary, looks: boolean>>"


def entropy(value: bytes) -> float:
    """Bits a byte."""
    return math.log2(len(value)) - sum(n * math.log2(n) for n in Counter(value).values()) / len(value) if value else 0.0


def looks_live(kind: str, value: bytes) -> bool:
    """Whether a value looks like one that a machine drew: enough entropy, letters and digits, no placeholder."""
    if PLACEHOLDERS.search(value):
        return False
    if kind == "key":
        return len(value) >= 64 and entropy(value) >= 4
    if kind in ("access", "hex"):
        return entropy(value.removeprefix(b"AKIA")) >= 2.5
    classes = CLASS[np.frombuffer(value, np.uint8)]
    if kind == "login":
        return len(value) >= 8 and entropy(value) >= 2.5
    if not ((classes == 3).any() and ((classes == 1) | (classes == 2)).any()):
        return False
    if kind == "assign":
        return len(value) >= 8 and entropy(value) >= 2.5
    if not ((classes == 1).any() and (classes == 2).any()):
        return False
    a, b = classes[classes > 0][:-1], classes[classes > 0][1:]
    turns = np.count_nonzero((a != b) & ~((a == 1) & (b == 2)))  # a capital begins a word: no sign of chance
    return bool(turns >= 0.25 * len(a) and np.count_nonzero((b == 3) & (a != 3)) >= 2 and entropy(value) >= 3.5)


def runs(buf: np.ndarray, off: np.ndarray, table: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of a class of bytes, at least so long, none across two rows."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = table[buf]
    step = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = step[::2], step[1::2]
    long = ends - starts >= least
    out = []
    for a, z in zip(starts[long].tolist(), ends[long].tolist()):
        i, j = np.searchsorted(off, [a, z - 1], "right")
        bounds = [a, *off[i:j].tolist(), z]
        out += [(x, y) for x, y in zip(bounds, bounds[1:]) if y - x >= least]
    return out


def places(data: bytes, word: bytes) -> Iterator[int]:
    i = data.find(word)
    while i >= 0:
        yield i
        i = data.find(word, i + 1)


def matches(data: bytes, off: np.ndarray, at: list[int], pattern: re.Pattern) -> Iterator[re.Match]:
    """Leftmost matches that don't overlap, of those that begin ``at`` given places; none goes beyond its row."""
    end = 0
    rows = np.searchsorted(off, at, "right").tolist()
    for i, r in zip(at, rows):
        if i >= end and (m := pattern.match(data, i, int(off[r]))):
            end = m.end()
            yield m


def candidates(buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, value) of all candidates of some texts, by byte."""
    data, low = buf.tobytes(), LOWER[buf].tobytes()
    out = []
    at = sorted(i for name in NAMES for i in places(low, name))
    for m in matches(data, off, at, ASSIGN):
        if len(m[2]) >= LEAST["assign"]:
            out.append((m.start(), 0, m.end(), m[2].rstrip(b".")))
    for m in matches(data, off, list(places(data, b"AKIA")), ACCESS):
        if len(m[0]) >= LEAST["access"]:
            out.append((m.start(), 1, m.end(), m[0]))
    out += [(a, 2, z, data[a:z]) for a, z in runs(buf, off, HEX, LEAST["hex"])]
    for m in matches(data, off, list(places(data, b"-----BEGIN ")), KEY):
        out.append((m.start(), 3, m.end(), b"".join(m[1].split())))
    for m in matches(data, off, list(places(data, b"://")), LOGIN):
        out.append((m.start(1), 4, m.end(2), m[2]))
    taken = sorted((a, z) for a, _, z, _ in out)
    starts = np.array([a for a, _ in taken], np.int64)
    far = np.maximum.accumulate(np.array([z for _, z in taken], np.int64)) if taken else starts
    for a, z in runs(buf, off, MIXED, LEAST["token"]):
        k = int(np.searchsorted(starts, z)) - 1  # the last that begins before this one's end
        if k < 0 or far[k] <= a:
            if looks_live("token", data[a:z]):
                out.append((a, 5, z, data[a:z]))
    return sorted(out)


def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the list of their candidates: code points, digest of the value, and whether it looks live."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.binary()), ("looks", pa.bool_())]))
    for batch in batches:
        buf, off = flat(batch.column(3))
        found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for i, j in slices(off, 8 << 20):
            part, local = buf[off[i]:off[j]], off[i:j + 1] - off[i]
            got = candidates(part, local)
            rows = np.searchsorted(local, [g[0] for g in got], "right") - 1
            last = -1
            for (a, k, z, value), r in zip(got, rows.tolist()):
                first = int(local[r])
                if r != last:  # code points before each byte of this text
                    before = np.concatenate([[0], np.cumsum((part[first:local[r + 1]] & 0xC0) != 0x80)])
                    last = r
                found[i + r].append({"start": int(before[a - first]), "kind": k, "end": int(before[z - first]),
                                     "value": hashlib.blake2b(value, digest_size=16).digest(), "looks": looks_live(KINDS[k], value)})
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, kind)], ["doc_id", "owner", "repository", "found"])


def ownership(found: DataFrame) -> DataFrame:
    """``value, owners, repositories``: by how many distinct owners, and repositories of theirs, each value of ``value, owner, repository`` is held.

    Those without an owner count as one owner, those without a repository as one repository of their owner.
    """
    per_owner = found.groupBy("value", "owner", "repository").agg(F.lit(1).alias("_one")).groupBy("value", "owner").agg(F.count(F.lit(1)).alias("_n"))
    return per_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("_n").alias("repositories"))


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """``doc_id, found`` of every row: all candidates by start and kind, ``kind, start, end`` (code points), ``owners, repositories`` of the value, ``verdict``.

    ``live``: looks random, and one owner has it, or at most ``max_owners`` in at most ``max_repositories`` repositories; ``copied``: more have it;
    ``weak``: neither.  A null text is empty; rows that share a doc_id are rows of their own; without candidates, or without rows, the list, or the
    result, is empty.  Other columns are left out, whatever their names.  The lists are written once, without the texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    first = cut(rows.mapInArrow(find, f"doc_id long, owner string, repository string, found {FOUND}").withColumn("_r", F.monotonically_increasing_id()))
    blocks = 4 * width(spark)
    one = first.select("_r", F.pmod(F.xxhash64("_r"), F.lit(blocks)).alias("_b"), "owner", "repository", F.explode("found").alias("f")).select(
        "_r", "_b", "owner", "repository", "f.*")
    held = one.select("value", "_b").distinct().join(ownership(one), "value")  # a row for each block that asks
    known = one.join(held, ["value", "_b"])
    few = (F.col("owners") == 1) | ((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
    verdict = F.when(~few, "copied").when(F.col("looks"), "live").otherwise("weak")
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    item = F.struct("start", F.col("kind").alias("_k"), name.alias("kind"), "end", "owners", "repositories", verdict.alias("verdict"))
    lists = known.groupBy("_r").agg(F.array_sort(F.collect_list(item)).alias("found"))
    none = F.array().cast(lists.schema["found"].dataType)
    out = first.select("_r", "doc_id").join(lists, "_r", "left").select("doc_id", F.coalesce("found", none).alias("found"))
    return out.withColumn("found", F.transform("found", lambda f: f.dropFields("_k")))


def spans(found, *kinds: str):
    """Text ``kind:start:end,...`` of some kinds of a list, without the candidates beyond the base kinds that aren't live."""
    chosen = F.filter(found, lambda f: f["kind"].isin(*kinds) & (f["kind"].isin(*KINDS[:BASE]) | (f["verdict"] == "live")))
    return F.array_join(F.transform(chosen, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def secret_digest(scanned: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, numbers of base spans by kind, ``base_sha256`` of them, ``spans`` (base, and what is live beyond), ``n_live``, ``n_copied``."""
    def count(field: str, value: str):
        return F.size(F.filter("found", lambda f: f[field] == value)).cast("long").alias(f"n_{value}")

    return scanned.select("doc_id", *[count("kind", k) for k in KINDS[:BASE]], F.sha2(spans("found", *KINDS[:BASE]), 256).alias("base_sha256"),
                          spans("found", *KINDS).alias("spans"), *[count("verdict", v) for v in ("live", "copied")])
