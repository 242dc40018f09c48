"""LM scoring by context-tree weighting over bytes, beside a unigram word baseline.

Texts are lower-cased (A-Z) and read as UTF-8 bytes with an end symbol. Each byte is coded as eight
binary decisions; a decision's node is the bits so far within the byte, below each of the contexts of
0 to ``depth`` preceding bytes. Every node holds a Krichevsky-Trofimov estimate, and the estimates of
all depths are mixed with the context-tree weights: with Pe the node's own block probability and Pw
the weighted one, Pw = (Pe + product of the children's Pw) / 2. Block probabilities depend on counts
alone, so the weights come bottom-up from counts of all (depth + 1)-grams of the training texts, and
the frozen tree gives the code length of any byte.

At scale the model never is in one place. The tasks that read the texts cut them into chunks of at most
CHUNK_BYTES. A chunk asks for the code lengths of its distinct grams and the counts of its distinct
words, giving along how often its training texts hold each; its texts are packed beside these requests
in one table in the shared folder. Requests go to parts, grams by the three bytes before the predicted
one: a part folds all chunks' counts, builds its subtrees and answers each chunk. Two rounds do this: the
first adds up what the nodes of contexts of two bytes need, which is all that reaches the driver and is
broadcast (at most 255 * 65536 nodes); the second answers, and each chunk scores its texts. Requests and
answers travel as compressed arrays, one row per chunk and part. Code lengths travel with 14 bits of
precision. Memory: a chunk's distinct grams and words, a part's grams, and a piece of text or the longest
text. Chunks and parts grow in number with the input; what does not split further is the tree below one
context of three bytes.

Defined results: null text is the empty text, with one token, the end; null ids count as the empty
id, which is in the training part; repeated rows each count and each give a row; with no training
rows every bit has probability 1/2 and the base score is 0 per token; an empty table gives an empty
result. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, ship
from .simhash_dedup import LOWER

DEPTH = 6
END = 0xFF
#: Bytes of text of a chunk, per part of the tree, and that are counted or scored at once.
CHUNK_BYTES, PART_BYTES, PIECE_BYTES = 16 << 20, 4 << 20, 2 << 20
U = np.uint64
#: Bytes of context by which grams are dealt out; nodes of shorter contexts are built from their sums.
SPLIT = 3
MULT = U(0x9E3779B97F4A7C15)


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (depth + 1)-grams, one per byte and end, oldest byte highest; and where each text's begin."""
    pad = bytes([END]) * depth
    raw = np.frombuffer(b"".join([pad + t + b"\xff" for t in texts]), np.uint8)
    n = len(raw) - depth
    key = np.zeros(n, U)
    for d in range(depth + 1):
        key = (key << U(8)) | raw[d : d + n]
    sizes = np.array([len(t) + 1 for t in texts])
    # Between two texts lie the depth grams that predict the next one's padding.
    keep = np.ones(n, bool)
    drop = (np.cumsum(sizes + depth)[:-1, None] - depth + np.arange(depth)).ravel()
    keep[drop] = False
    return key[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def fold(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after six steps up; exact to about 1e-12 from 0.5 on."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        out -= np.log(x)
        x = x + 1
    return out + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - 2 * log_gamma(np.array([0.5])) - log_gamma(zeros + ones + 1)


def own_share(log_pe: np.ndarray, log_children: np.ndarray) -> np.ndarray:
    """The weight of a node's own estimate against its children's."""
    return 1 / (1 + np.exp(np.clip(log_children - log_pe, -700, 700)))


def build(keys: np.ndarray, n: np.ndarray, depth: int, least: int) -> tuple[dict, dict]:
    """Nodes of depths ``depth`` down to ``least`` from sorted gram counts that hold whole subtrees.

    nodes[d, j]: sorted keys (context and j bits), probability of a 1, share of the own estimate.
    top[j]: of depth ``least``: keys, zeros, ones, log Pw.
    """
    nodes, below = {}, {}
    for d in range(depth, least - 1, -1):
        k_d, n_d = fold(keys & U((1 << (8 * (d + 1))) - 1), n)
        now = {}
        for j in range(8):
            full = k_d >> U(7 - j)
            node = full >> U(1)
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, int)
            bit = (full & U(1)).astype(np.int64)
            u = node[first]
            ones = np.add.reduceat(n_d * bit, first) if len(first) else np.zeros(0, np.int64)
            zeros = (np.add.reduceat(n_d, first) if len(first) else ones) - ones
            log_pe = kt_block(zeros, ones)
            if d == depth:
                log_pw, share = log_pe, np.ones(len(u))
            else:
                child, child_pw = below[j]
                at = np.searchsorted(u, child & U((1 << (8 * d + j)) - 1))
                down = np.bincount(at, child_pw, len(u)) if len(u) else log_pe
                log_pw, share = np.logaddexp(log_pe, down) - np.log(2), own_share(log_pe, down)
            nodes[d, j] = (u, (ones + 0.5) / (zeros + ones + 1.0), share)
            now[j] = (u, log_pw, zeros, ones)
        below = {j: v[:2] for j, v in now.items()}
    return nodes, {j: (u, zeros, ones, log_pw) for j, (u, log_pw, zeros, ones) in now.items()}


def build_top(level: dict, least: int) -> dict:
    """Nodes of the depths below ``least``, from those of depth ``least``, or from their sums by node of depth ``least`` - 1."""
    nodes = {}
    for d in range(least - 1, -1, -1):
        up = {}
        for j, (child, zeros, ones, log_pw) in level.items():
            u, at = np.unique(child & U((1 << (8 * d + j)) - 1), return_inverse=True)
            z, o, down = (np.bincount(at, x, len(u)) for x in (zeros, ones, log_pw))
            log_pe = kt_block(z, o)
            nodes[d, j] = (u, (o + 0.5) / (z + o + 1.0), own_share(log_pe, down))
            up[j] = (u, z, o, np.logaddexp(log_pe, down) - np.log(2))
        level = up
    return nodes


def log2_probability(keys: np.ndarray, nodes: dict, top: dict, depth: int) -> np.ndarray:
    """Of each gram's last byte after the others. keys sorted; a node never seen has estimate 1/2."""
    out = np.zeros(len(keys))
    for j in range(8):
        p = np.full(len(keys), 0.5)
        path = keys >> U(8 - j)
        for d in range(depth, -1, -1):
            u, one, share = nodes[d, j] if (d, j) in nodes else top[d, j]
            if not len(u):
                continue
            q = path & U((1 << (8 * d + j)) - 1)
            at = np.minimum(np.searchsorted(u, q), len(u) - 1)
            hit = np.flatnonzero(u[at] == q)
            at = at[hit]
            s = share[at].astype(float)
            o = one[at].astype(float)
            if one.dtype == np.float16:
                o = 1 / (1 + np.exp(-o))
            p[hit] = s * o + (1 - s) * p[hit] if d < depth else o
        bit = ((keys >> U(7 - j)) & U(1)).astype(bool)
        out += np.log2(np.where(bit, p, 1 - p))
    return out


def pack(a: np.ndarray) -> bytes:
    """Fixed-size numbers as compressed planes of bytes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind)[:, 0]


def part_of(keys: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of the tree that holds each gram, by its context of SPLIT bytes."""
    context = (keys >> U(8)) & U((1 << (8 * SPLIT)) - 1)
    return ((context * MULT >> U(24)) % U(n_parts)).astype(np.int32)


def counts_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and how many there are of each."""
    keys = np.sort(grams(texts, depth)[0])
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.concatenate([first, [len(keys)]]))


REQUEST = "kind byte, chunk long, part int, key binary, n binary"


def _request(depth: int, n_parts: int):
    """Per chunk and part: distinct grams (kind 0) and words (kind 1) with their counts in training texts; and the texts, packed by piece (kind 2)."""
    names = ("kind", "chunk", "part", "key", "n")
    kinds = (pa.int8(), pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def put_out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def of_chunk(chunk, have, words):
        keys, n = have
        part = part_of(keys, n_parts)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        rows = [(0, chunk, int(part[at[0]]), pack(keys[at]), pack(n[at])) for at in np.split(order, cuts)]
        by_part: dict[int, list[bytes]] = {}
        for w in sorted(words):
            by_part.setdefault(zlib.crc32(w) % n_parts, []).append(w)
        rows += [(1, chunk, p, zstandard.ZstdCompressor(level=3).compress(b" ".join(some)), pack(np.array([words[w] for w in some], np.int64))) for p, some in by_part.items()]
        for i in range(0, len(rows), 200):
            yield put_out(rows[i : i + 200])

    def run(batches):
        chunk, have, words, held, size, whole, piece = TaskContext.get().partitionId() << 32, None, Counter(), [], 0, 0, 0

        def of_piece():
            nonlocal have, held, size, piece
            for out in (False, True):
                texts = [t for _, t, o in held if o == out]
                if texts:
                    keys, n = counts_of(texts, depth)
                    n = n * (not out)
                    have = (keys, n) if have is None else fold(np.concatenate([have[0], keys]), np.concatenate([have[1], n]))
            rows = pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.large_binary())], ("doc_id", "text"))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(rows)
            packed = (2, chunk, piece, sink.getvalue().to_pybytes(), None)
            held, size, piece = [], 0, piece + 1
            return put_out([packed])

        for batch in batches:
            for doc_id, out, raw in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                text = raw.translate(LOWER)
                held.append((doc_id, text, out))
                if out:
                    words.update(dict.fromkeys(text.split(), 0))
                else:
                    words.update(text.split())
                size += len(text) + 1
                whole += len(text) + 1
                if size >= PIECE_BYTES or whole >= CHUNK_BYTES:
                    yield of_piece()
                if whole >= CHUNK_BYTES:
                    yield from of_chunk(chunk, have, words)
                    chunk, have, words, whole, piece = chunk + 1, None, Counter(), 0, 0
        if held:
            yield of_piece()
        if have is not None:
            yield from of_chunk(chunk, have, words)

    return run


def words_in(raw: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(raw).split(b" ")


def parts(batches):
    """(kind, rows) of each part, rows as (chunk, packed keys, keys, counts); the input is sorted by part and kind."""
    now, held = None, []
    for batch in batches:
        for part, kind, chunk, key, n in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "chunk", "key", "n")), strict=True):
            if (part, kind) != now:
                if held:
                    yield now[1], held
                now, held = (part, kind), []
            held.append((chunk, key, words_in(key) if kind else unpack(key, U), unpack(n, np.int64)))
    if held:
        yield now[1], held


def counts_of_words(part) -> Counter:
    out = Counter()
    for _, _, words, n in part:
        for w, c in zip(words, n.tolist(), strict=True):
            out[w] += c
    return out


def tree_of(part, depth: int):
    """A part's distinct grams, the nodes of its subtrees and their level of SPLIT bytes."""
    keys, n = fold(np.concatenate([p[2] for p in part]), np.concatenate([p[3] for p in part]))
    seen = n > 0
    if not seen.any():
        return keys, {(d, j): (np.zeros(0, U),) * 3 for d in range(SPLIT, depth + 1) for j in range(8)}, {}
    return keys, *build(keys[seen], n[seen], depth, SPLIT)


def _sums(depth: int):
    """What nodes of contexts of SPLIT - 1 bytes need of their children: counts and log Pw. Slot -1: distinct words and words."""

    def run(batches):
        for kind, part in parts(batches):
            if kind:
                n = counts_of_words(part).values()
                level = {-1: [np.zeros(1, U), np.array([sum(c > 0 for c in n)]), np.array([sum(n)]), np.zeros(1)]}
            else:
                level = {}
                for j, (u, *sums) in tree_of(part, depth)[2].items():
                    up, at = np.unique(u & U((1 << (8 * (SPLIT - 1) + j)) - 1), return_inverse=True)
                    level[j] = [up, *(np.bincount(at, x, len(up)) for x in sums)]
            for slot, (up, zeros, ones, log_pw) in level.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(up), slot, np.int16)), pa.array(up.view(np.int64)), pa.array(zeros.astype(np.int64)), pa.array(ones.astype(np.int64)), pa.array(log_pw)],
                    ("slot", "key", "zeros", "ones", "log_pw"),
                )

    return run


def short(bits: np.ndarray) -> np.ndarray:
    """To 14 bits of precision, so the last byte is zero."""
    return ((bits.astype(np.float32).view(np.uint32) + np.uint32(1 << 8)) & np.uint32(0xFFFFFE00)).view(np.float32)


def _answer(depth: int, shared):
    """For each chunk that asks: its grams and their code lengths in bits, or its words and their counts."""

    def run(batches):
        top = shared.value
        for kind, part in parts(batches):
            if kind:
                counts = counts_of_words(part)
                answers = (np.array([counts[w] for w in p[2]], np.int64) for p in part)
            else:
                keys, nodes, _ = tree_of(part, depth)
                bits = short(log2_probability(keys, nodes, top, depth))
                del nodes
                answers = (bits[np.searchsorted(keys, p[2])] for p in part)
            rows = [(kind, p[0], p[1], pack(a)) for p, a in zip(part, answers, strict=True)]
            for i in range(0, len(rows), 200):
                columns = zip(zip(*rows[i : i + 200], strict=True), (pa.int8(), pa.int64(), pa.binary(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ("kind", "chunk", "key", "n"))

    return run


def _score(depth: int, base: dict):
    """Rows come sorted by chunk and kind: answers for grams (0) and words (1), then the packed texts (2)."""

    def log_of(n):
        return np.log10((n + 0.5) / base["denominator"])

    def scores(ids, texts, keys, bits, words):
        mine, starts = grams(texts, depth)
        order = np.argsort(mine)
        ordered = mine[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        per_gram = bits[np.searchsorted(keys, ordered[new])]
        per_place = np.empty(len(mine))
        per_place[order] = per_gram[np.cumsum(new) - 1]
        score = np.add.reduceat(per_place, starts) * np.log10(2)
        counts = [np.array([words[w] for w in t.split()], np.int64) for t in texts]
        n_words, known, sums = (np.array(x) for x in zip(*((len(c), np.count_nonzero(c), log_of(c).sum()) for c in counts), strict=True))
        return pa.RecordBatch.from_arrays(
            [
                ids.cast(pa.int64()), pa.array(n_words + 1, pa.int64()), pa.array(known + (base["end"] > 0), pa.int64()),
                pa.array(sums + log_of(base["end"]), pa.float64()), pa.array(score, pa.float64()), pa.array([len(t) + 1 for t in texts], pa.int64()),
            ],
            ("doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes"),
        )

    def run(batches):
        now, answers, words, known = None, [], {}, None
        for batch in batches:
            for chunk, kind, key, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "key", "n")), strict=True):
                if chunk != now:
                    now, answers, words, known = chunk, [], {}, None
                if kind == 0:
                    answers.append((unpack(key, U), unpack(n, np.float32)))
                elif kind == 1:
                    words.update(zip(words_in(key), unpack(n, np.int64).tolist(), strict=True))
                else:
                    if known is None:
                        keys, code = (np.concatenate(x) for x in zip(*answers, strict=True))
                        order = np.argsort(keys)
                        known, answers = (keys[order], code[order].astype(float)), []
                    rows = pa.ipc.open_stream(key).read_next_batch()
                    yield scores(rows.column("doc_id"), rows.column("text").to_pylist(), *known, words)

    return run


def top_of(sums: DataFrame) -> dict:
    """Nodes of contexts of fewer than SPLIT bytes; at most 255 * 65536 sums reach the driver."""
    table = sums.toArrow()
    slot, key = table["slot"].to_numpy(), table["key"].to_numpy().view(U)
    level = {}
    for j in range(8):
        at = np.flatnonzero(slot == j)
        at = at[np.argsort(key[at])]
        level[j] = (key[at], *(table[c].to_numpy()[at] for c in ("zeros", "ones", "log_pw")))
    return build_top(level, SPLIT)


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row per row of docs."""
    if depth < SPLIT:
        raise ValueError(f"depth below {SPLIT}")
    spark = docs.sparkSession
    ship(spark)

    def held_out(c):
        return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("bytes"), F.count(F.when(~F.col("held_out"), 1)).alias("ends")).first()
    n_chunks, n_parts = (max(8, -(-size.bytes // b)) for b in (CHUNK_BYTES, PART_BYTES))

    def dealt(df, n, *keys):
        return df.repartition(max(partitions(spark), n), keys[0]).sortWithinPartitions(*keys)

    asked = materialize(rows.mapInArrow(_request(depth, n_parts), REQUEST), "asked")
    requests = dealt(asked.where("kind < 2"), n_parts // 4, "part", "kind")
    sums = requests.mapInArrow(_sums(depth), "slot short, key long, zeros long, ones long, log_pw double")
    sums = materialize(sums.groupBy("slot", "key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "log_pw")]), "sums")
    words = sums.where("slot = -1").first()
    n, distinct = (words.ones if words else 0) + size.ends, (words.zeros if words else 0) + (size.ends > 0)
    base = {"end": size.ends, "denominator": n + 0.5 * (distinct + 1)}
    top = spark.sparkContext.broadcast(top_of(sums.where("slot >= 0")))
    answers = requests.mapInArrow(_answer(depth, top), "kind byte, chunk long, key binary, n binary")
    both = answers.unionByName(asked.where("kind = 2").select("kind", "chunk", "key", "n"))
    # More tasks than chunks, so few tasks get two.
    out = dealt(both, 3 * n_chunks, "chunk", "kind").mapInArrow(_score(depth, base), "doc_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
