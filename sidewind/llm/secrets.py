"""Secret scan with corpus-wide ownership frequency.

Candidates are found by patterns in whole texts. The hash of each candidate's value is counted over
the corpus by distinct repositories and owners: a value that several owners share is a widely copied
example, one that stays with a single owner looks live. The base kinds are found by the contract's
patterns; the method adds spans of further credential formats, which have telling prefixes.

Hot groups: a value that a third of all rows share is folded by map-side combination to one row per
(value, owner, repository) before it is counted, and its verdict goes back to its rows by broadcast.

Defined results: null text is the empty text, with no spans and empty strings; a null owner or
repository counts as one unnamed owner or repository; repeated rows each give a row and do not
raise the count of owners; an empty table gives an empty result. Only the id, text, repository and
owner columns are read. Values are never put out, only their hashes.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, ship

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A text without any of these, in either case, holds no assignment.
ASSIGN_WORDS = ("passw", "secret", "token", "api")
#: Kinds that the method adds: name, a literal each text with one holds, pattern, group of the value.
MORE = [
    ("github", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"), 0),
    ("gitlab", "glpat-", re.compile(r"\bglpat-[A-Za-z0-9_-]{20,}"), 0),
    ("slack", "xox", re.compile(r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"), 0),
    ("stripe", "_live_", re.compile(r"\b[rs]k_live_[A-Za-z0-9]{16,}"), 0),
    ("google", "AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}"), 0),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0),
    ("private_key", "PRIVATE KEY", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+?-----END (?:[A-Z]+ )?PRIVATE KEY-----"), 0),
    ("url_password", "://", re.compile(r"://[^/\s:@]+:([^/\s:@]{6,})@"), 1),
]
BASE = ("assign", "access", "hex")
#: Kinds in the order in which spans with one start are listed.
ORDER = {k: n for n, k in enumerate((*BASE, *(m[0] for m in MORE)))}

FOUND = "doc_id long, row long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,hash:string>>"


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all spans, in code points, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    for kind, literal, pattern, group in MORE:
        if literal in text:
            out += [(kind, *m.span(), m[group]) for m in pattern.finditer(text)]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def _scan(batches):
    names = [f.split(" ")[0] for f in re.sub(r"<.*>", "", FOUND).split(", ")]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())]))
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            spans = scan(text or "")
            base = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans if k in BASE)
            n = [sum(s[0] == k for s in spans) for k in BASE]
            found = [{"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()} for k, a, b, v in spans]
            rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans), found))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "row", "repo", "owner")] + [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), kind), strict=True)], names
        )


def secret_scan(docs: DataFrame, repo: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text", shared_by: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and
    candidates: array of (kind, start, end, hash, repos, owners, live).

    live: fewer than ``shared_by`` owners have the value.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"),
        F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
    ).select("doc_id", "row", "repo", "owner", "text")
    found = materialize(rows.mapInArrow(_scan, FOUND), "found")
    spans = found.where(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("s")).select("row", "repo", "owner", "s.*")
    # Folded step by step, each with map-side combination: rows to (value, owner, repository), to value.
    folded = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = folded.groupBy("hash", "owner").agg(F.sum("n").alias("n"))
    owners = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("n"))
    repos = folded.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("repos"))
    owned = materialize(owners.join(repos, "hash"), "owned")
    total = owned.agg(F.sum("n")).first()[0] or 0
    judged = join_groups(spans.drop("repo", "owner"), owned, ["hash"], "n", total)
    candidates = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind", "hash", "repos", "owners", (F.col("owners") < shared_by).alias("live")))).alias("candidates")
    )
    return found.join(candidates, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "candidates")
