"""N-gram Jaccard join with multiple-global-order filtering.

Texts are sets of word shingles. Two sets with Jaccard >= t share a token in their prefixes under *every* global token order
(a prefix holds the first ``n - ceil(t n) + 1`` tokens). Orders here put frequent tokens last and break ties by a different
mixing of the token's hash. Candidates share a prefix token under the first order. Under the second and third, prefixes are
longer by as much again, and similar sets then share ``n - ceil(t n) + 1`` tokens of each: only pairs that pass all orders are
verified on whole sets. The sets are made again from the texts of the documents concerned alone.

Postings carry their token's position in the prefix. At the first token that two sets share, nothing before it is common, so
``min(n_a - i, n_b - j)`` bounds the intersection; a pair must pass this bound at some shared token. A bitmap of each set
(``64 * WORDS`` bits, one per token by hash) bounds the intersection again: every bit of A that B lacks is a token of A that B
lacks. It is looked up for the sets of candidate pairs alone; pairs that pass meet bitmaps of ``FINE`` bits a token before whole sets
move. All these bounds only drop pairs that can't be similar.

Equal sets are one node, so copies never make pairs. Postings are shuffled once, sorted by token. The task that reads a list
makes a star (every set with the one whose token comes earliest), a number of pairs linear in the list, and writes out, of
lists with further pairs that the bound allows, the members of these pairs. Verified stars are joined to components. Members
then pair across components: in lists of at most ``LONG_LIST`` sets at once, in longer ones by blocks of about ``BLOCK``
sets that lie outside the list's largest component against blocks of the whole list, with the bitmaps, so that no list is one
task's work. Of a pair of blocks, the pairs that the bounds allow are first thinned to a forest of the likeliest ones that spans
the components they touch: a group of near copies then makes pairs in number of its sets, not of their square. Once the forests
are verified, all pairs of the touched components that still lie apart are tested. Every pair that passes the bounds is thus
tested or already connected, so components are exact.

Frequent tokens are counted over all texts: tokens found in ``LOCAL`` documents or more of a run of texts are summed over the
corpus, and the ``HEAVY`` most frequent ones form a table of fixed size. Any table gives right results; it only orders.
Tokens and sets are told apart by 64-bit hashes.

Joins on a pair's end may meet a hub that many pairs share; they are plain shuffled joins, whose large partitions adaptive
execution splits.

Defined results: null, empty and wordless texts have no shingles, stay alone, and have their own id; a null id takes part and
never names a component that has another; ties of the similarity with the threshold link; an empty table stays empty; extra
columns are ignored. Rows of one id may hold different texts: each row is judged by its own text. ``keep_one`` keeps one row
of each component, that with the least id (of rows with this id one, by a hash of the text), and every row without shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_table, drop_tables, hidden, in_table, shown, table, text_groups, written

LOCAL, HEAVY, SALT_FROM, SALTS = 4, 1 << 16, 200, 16
WORDS, LONG_LIST, BLOCK = 16, 256, 1024
FINE, FINE_CELL, CELL, MIN_BLOCKS = 8, 1 << 24, 1 << 21, 4
BITMAP = [f"s{i}" for i in range(WORDS)]
NAMES = ["kind", "key", "h", "id", "n", *BITMAP]
#: Characters of texts in work at once, and set ids that a task remembers so as not to post a copy again; both only bound memory.
GROUP_CHARS, SEEN = 2_000_000, 200_000
#: Odd multipliers that make the three orders (arbitrary fixed values).
MIXERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; A-Z count as a-z."""
    from xxhash import xxh3_64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) < k:
        return np.array([xxh3_64_intdigest(b" ".join(w))] if w else [], np.uint64)
    parts = []
    for a in range(0, len(w) - k + 1, 500_000):  # a huge text is hashed in blocks
        block = w[a : a + 500_000 + k - 1]
        grams = set(map(b" ".join, zip(*(block[i:] for i in range(k)))))  # noqa: B905  the shorter ends it
        parts.append(np.fromiter(map(xxh3_64_intdigest, grams), np.uint64, len(grams)))
    return np.unique(np.concatenate(parts))


def set_id(hashes: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` longs with a bit for each token."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(hashes % np.uint64(64 * WORDS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def share(n: int, num: int, den: int) -> int:
    """The length of the prefix of a set of ``n`` tokens."""
    return n - -(-num * n // den) + 1


def ordered(hashes: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """The tokens of a set under an order."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * MIXERS[order]
    return hashes[np.lexsort((mixed ^ (mixed >> np.uint64(32)), frequency(hashes, heavy)))]


def prefix(hashes: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], order: int, num: int, den: int) -> np.ndarray:
    return ordered(hashes, heavy, order)[: share(len(hashes), num, den)]


def frequency(hashes: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    tokens, counts = heavy
    if not len(tokens):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
    return np.where(tokens[at] == hashes, counts[at], 0)


def _survey(source: DataFrame, k: int) -> DataFrame:
    """Rows (kind 0: key, row hash, set id, size, bitmap) of documents and (kind 1: token, count) of frequent tokens."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys, hashes, texts = (batch.column(c) for c in range(3))
            texts = texts.to_pylist()
            for a, b in text_groups(texts):
                sets = [shingles(t, k) for t in texts[a:b]]
                ids = [set_id(s) if len(s) else None for s in sets]
                token, count = np.unique(np.concatenate([*{i: s for i, s in zip(ids, sets, strict=True) if i is not None}.values(), np.zeros(0, np.uint64)]), return_counts=True)
                often = count >= LOCAL
                token, count = token[often].view(np.int64), count[often]
                bits = np.zeros((b - a, WORDS), np.int64)
                for i, x in enumerate(sets):
                    bits[i] = bitmap(x)
                rows = [pa.array(np.zeros(b - a, np.int32)), keys[a:b], hashes[a:b], pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
                yield pa.record_batch([*rows, *(pa.array(np.ascontiguousarray(c)) for c in bits.T)], NAMES)
                m = len(token)
                none = pa.nulls(m, pa.int64())
                yield pa.record_batch([pa.array(np.ones(m, np.int32)), none, none, pa.array(token), pa.array(count), *[none] * WORDS], NAMES)

    return source.select("key", "h", "text").mapInArrow(run, "kind int, key long, h long, id long, n long" + "".join(f", {c} long" for c in BITMAP))


def _postings(docs: DataFrame, heavy, k: int, num: int, den: int) -> DataFrame:
    """token, salt, id, n, pos of the prefixes under the first order; each set once per task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = heavy.value
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in text_groups(texts, GROUP_CHARS):
                tokens, salts, ids, sizes, places = ([np.zeros(0, x)] for x in (np.int64, np.int32, np.int64, np.int32, np.int32))
                for t in texts[a:b]:
                    s = shingles(t, k)
                    if not len(s) or (i := set_id(s)) in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(i)
                    p = prefix(s, known, 0, num, den)
                    tokens.append(p.view(np.int64))
                    salts.append(np.where(frequency(p, known) >= SALT_FROM, i % SALTS, 0).astype(np.int32))
                    ids.append(np.full(len(p), i, np.int64))
                    sizes.append(np.full(len(p), len(s), np.int32))
                    places.append(np.arange(len(p), dtype=np.int32))
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (tokens, salts, ids, sizes, places)], ["token", "salt", "id", "n", "pos"])

    return docs.mapInArrow(run, "token long, salt int, id long, n int, pos int")


def fits(n, pos, m, at, num: int, den: int):
    """The bound by positions, for numbers, arrays or columns: the sets may be similar if this is the first token they share."""
    return np.minimum(n - pos, m - at) * (num + den) >= (n + m) * num


def _by_length(m: np.ndarray, starts: np.ndarray, cells: int = 1 << 18) -> Iterator[np.ndarray]:
    """Positions of the members of lists of equal length, as blocks (lists, length), with about ``cells`` pairs in a block."""
    for length in np.unique(m):
        at = starts[m == length]
        step = max(1, cells // int(length * length))
        for a in range(0, len(at), step):
            yield at[a : a + step, None] + np.arange(length)


def _whole_lists(batches: Iterator, names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The numpy columns of batches sorted by their first column, regrouped so that no list is cut."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last list may go on
        if held and (cut or held[0][0][0] != now[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in now], strict=True)]
            held = []
        elif cut:
            yield [c[:cut] for c in now]
        held.append([c[cut:] for c in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _lists(postings: DataFrame, heavy, num: int, den: int) -> DataFrame:
    """The postings that give pairs: ``hub`` names the other end of a star's pair; ``more`` is 1 where the set has further
    partners in a short list, 2 in a long or salted one."""

    def emit(token: np.ndarray, ids: np.ndarray, n: np.ndarray, pos: np.ndarray, known):
        import pyarrow as pa

        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])))  # several tasks may post a set
        token, ids, n, pos = token[fresh], ids[fresh], n[fresh].astype(np.int64), pos[fresh].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        m = np.diff(np.append(starts, len(token)))
        of = np.repeat(np.arange(len(m)), m)
        first = np.lexsort((ids, pos * 20 // n, of))[starts]
        hub = first[of]
        own = hub == np.arange(len(ids))
        star = ~own & fits(n, pos, n[hub], pos[hub], num, den)
        salted = frequency(token[starts].view(np.uint64), known) >= SALT_FROM
        more = np.where(np.repeat(salted | (m > LONG_LIST), m), 2, 0).astype(np.int32)
        short = ~salted & (m > 2) & (m <= LONG_LIST)
        for at in _by_length(m[short], starts[short]):
            pairs = fits(n[at][:, :, None], pos[at][:, :, None], n[at][:, None, :], pos[at][:, None, :], num, den)
            pairs &= ~(own[at][:, :, None] | own[at][:, None, :] | np.eye(at.shape[1], dtype=bool))
            more[at] = pairs.any(2)
        keep = star | (more > 0)
        columns = [pa.array(token[keep]), pa.array(ids[keep]), pa.array(n[keep]), pa.array(pos[keep]), pa.array(ids[hub][keep], mask=~star[keep]), pa.array(more[keep])]
        return pa.record_batch(columns, ["token", "id", "n", "pos", "hub", "more"])

    def run(batches: Iterator) -> Iterator:
        for columns in _whole_lists(batches, ("token", "id", "n", "pos")):
            yield emit(*columns, heavy.value)

    dealt = postings.repartition(_partitions(postings), "token", "salt").sortWithinPartitions("token", "id")
    return dealt.select("token", "id", "n", "pos").mapInArrow(run, "token long, id long, n long, pos long, hub long, more int")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _in_order(a: np.ndarray, b: np.ndarray):
    """Distinct pairs, the lesser id first."""
    import pyarrow as pa

    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _short_pairs(placed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components in short lists (token, root, id, n, pos) that the bound allows."""

    def run(batches: Iterator) -> Iterator:
        for token, root, ids, n, pos in _whole_lists(batches, ("token", "root", "id", "n", "pos")):
            starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            m = np.diff(np.append(starts, len(token)))
            several = m > 1
            for at in _by_length(m[several], starts[several]):
                pairs = fits(n[at][:, :, None], pos[at][:, :, None], n[at][:, None, :], pos[at][:, None, :], num, den) & (root[at][:, :, None] < root[at][:, None, :])
                x, y, z = np.nonzero(pairs)
                if len(x):
                    yield _in_order(ids[at][x, y], ids[at][x, z])

    dealt = placed.repartition(_partitions(placed), "token").sortWithinPartitions("token")
    return dealt.select("token", "root", "id", "n", "pos").mapInArrow(run, "a long, b long")


def _forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of the edges (x, y) of a spanning forest, best edges first in the input; no other forest has better ones."""
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    u, v = ends[: len(x)], ends[len(x) :]
    label, live, chosen = np.arange(len(nodes)), np.arange(len(x)), [np.zeros(0, np.int64)]
    while len(live := live[label[u[live]] != label[v[live]]]):
        p, q = label[u[live]], label[v[live]]
        best, parent = np.full(len(nodes), -1), np.arange(len(nodes))
        best[np.stack([p, q], 1).ravel()[::-1]] = np.repeat(live, 2)[::-1]  # the last one written stays
        own = np.flatnonzero(best >= 0)
        edge = best[own]
        chosen.append(np.unique(edge))
        parent[own] = label[u[edge]] + label[v[edge]] - own
        mutual = (parent[parent] == np.arange(len(nodes))) & (np.arange(len(nodes)) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while (parent != (up := parent[parent])).any():
            parent = up
        label = parent[label]
    return np.sort(np.concatenate(chosen))


def _long_pairs(placed: DataFrame, survey: DataFrame, num: int, den: int, thin: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs of different components in long lists that both bounds allow, by blocks: sets outside the list's largest
    component against all sets. With ``thin``, of two blocks only the likeliest pairs that connect all components that their
    pairs connect. Also the table that the pairs are read from."""
    cells = placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m"))
    sizes = cells.groupBy("token").agg(F.sum("m").alias("m"), F.max_by("root", F.struct("m", "root")).alias("main"), F.max("m").alias("most")).where("m > most")
    blocks = sizes.select("token", "main", F.expr(f"(m - most + {BLOCK - 1}) div {BLOCK}").alias("us"), F.expr(f"(m + {BLOCK - 1}) div {BLOCK}").alias("vs"))
    found = written(placed.join(blocks, "token"), "long-lists")
    drawn = found.join(_drawn(survey, found.select("id")).drop("n"), "id")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["root", "id", "n", "pos", *BITMAP]
    named = lambda x: [F.col(c).alias(f"{x}_{c}") for c in columns]
    u = drawn.where("root <> main").select(F.col("token").alias("u_token"), F.pmod(F.xxhash64("id"), "us").alias("u_i"), every("vs").alias("u_j"), *named("u"))
    v = drawn.select(F.col("token").alias("v_token"), every("us").alias("v_i"), F.pmod(F.xxhash64("id"), "vs").alias("v_j"), (F.col("root") == F.col("main")).alias("inner"), *named("v"))

    def run(left, right):
        import pyarrow as pa

        x, y = ({c: t.column(f"{side}_{c}").to_numpy() for c in columns} for side, t in (("u", left), ("v", right)))
        inner = right.column("inner").to_numpy()
        may = fits(x["n"][:, None], x["pos"][:, None], y["n"][None], y["pos"][None], num, den)
        i, j = np.nonzero(may & (x["root"][:, None] != y["root"][None]) & (inner[None] | (x["id"][:, None] < y["id"][None])))
        bits = [[s[c].view(np.uint64) for c in BITMAP] for s in (x, y)]  # of a signed number the bits of its absolute value would count
        out, alone = [], [s["n"] - sum(np.bitwise_count(w).astype(np.int64) for w in b) for s, b in zip((x, y), bits, strict=True)]
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.float64)]
        for a in range(0, len(i), 1 << 16):
            p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            both = sum(np.bitwise_count(v[p] & w[q]).astype(np.int64) for v, w in zip(*bits, strict=True))
            most, total = np.minimum(alone[0][p] + both, alone[1][q] + both), x["n"][p] + y["n"][q]
            good = most * (num + den) >= total * num
            if not thin:
                out.append(_in_order(x["id"][p[good]], y["id"][q[good]]))
                continue
            held = [np.concatenate(c) for c in zip(held, (p[good], q[good], most[good] / total[good]), strict=True)]
            first, second = x["id"][held[0]], y["id"][held[1]]
            by = np.lexsort((np.maximum(first, second), np.minimum(first, second), -held[2]))  # lists of one group choose alike
            held = [c[by] for c in held]
            forest = _forest(x["root"][held[0]], y["root"][held[1]])
            held = [c[forest] for c in held]
        if thin:
            out.append(_in_order(x["id"][held[0]], y["id"][held[1]]))
        return pa.Table.from_batches(out, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    cell = lambda x: [f"{x}_{c}" for c in ("token", "i", "j")]
    return u.groupBy(*cell("u")).cogroup(v.groupBy(*cell("v"))).applyInArrow(run, "a long, b long"), found


def _drawn(survey: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n and bitmap of the sets whose id is in the one column of ``ids`` (and of a few others), one row a set."""
    bits = bit_table(ids, ids.columns[0])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(in_table(bits.value, batch.column(0).to_numpy())))

    rows = survey.where("kind = 0 AND id IS NOT NULL").select("id", "n", *BITMAP)
    return rows.mapInArrow(run, rows.schema).dropDuplicates(["id"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))


def _sifted(pairs: DataFrame, survey: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the bound by bitmaps allows, with sizes."""
    drawn = _drawn(survey, _ends(pairs))
    side = lambda x: drawn.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", *BITMAP)])
    both = lambda of: sum((F.bit_count(of(F.col(f"a_{c}"), F.col(f"b_{c}"))) for c in BITMAP), F.lit(0))
    a_alone, b_alone = both(lambda p, q: p.bitwiseAND(F.bitwise_not(q))), both(lambda p, q: q.bitwiseAND(F.bitwise_not(p)))
    alike = F.least(F.col("a_n") - a_alone, F.col("b_n") - b_alone) * (num + den) >= (F.col("a_n") + F.col("b_n")) * num
    return pairs.join(side("b"), "b").join(side("a"), "a").where(alike).select("a", "b", "a_n", "b_n")


class _Set:
    """A set's tokens, and its longer prefixes under the second and third order, each sorted."""

    def __init__(self, tokens: np.ndarray, heavy, num: int, den: int):
        self.tokens, self.share = tokens, share(len(tokens), num, den)
        self.longer = [np.sort(ordered(tokens, heavy, o)[: 2 * self.share - 1]) for o in (1, 2)]


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def similar(x: _Set, y: _Set, num: int, den: int) -> bool:
    """The filters of the second and third order, and then the exact test."""
    least = min(x.share, y.share)
    if any(_common(p, q) < least for p, q in zip(x.longer, y.longer, strict=True)):
        return False
    both = _common(x.tokens, y.tokens)
    return both * den >= (len(x.tokens) + len(y.tokens) - both) * num


def fine_bitmap(hashes: np.ndarray) -> np.ndarray:
    """At least ``FINE`` bits a token, a power of two in all, so that the larger of two can be folded."""
    bits = np.zeros(max(64, 1 << (FINE * len(hashes) - 1).bit_length()), np.uint8)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def alike(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray], num: int, den: int) -> bool:
    """The bound by fine bitmaps, of (size, bitmap)."""
    (n, v), (m, w) = x, y
    while len(v) > len(w):
        v = v[: len(v) // 2] | v[len(v) // 2 :]
    while len(w) > len(v):
        w = w[: len(w) // 2] | w[len(w) // 2 :]
    v_alone, w_alone = int(np.bitwise_count(v & ~w).sum()), int(np.bitwise_count(w & ~v).sum())
    return min(n - v_alone, m - w_alone) * (num + den) >= (n + m) * num


#: A cell's number in the low bits of a set's id: any odd factor below 2^32 (arbitrary fixed value).
SPREAD = 0x9E3779B1


def _met(pairs: DataFrame, source: DataFrame, nodes: DataFrame, k: int, tokens: int, pack: Callable, unpack: Callable, test: Callable, spanning: bool = False) -> DataFrame:
    """The pairs (a, b, a_n, b_n) whose sets pass ``test``, each set made once, packed, and sent where its pairs are.

    Ids are cut into blocks of about ``tokens`` tokens, and a pair is dealt to the cell of its two blocks. Bit tables tell the
    tasks that read the texts which rows hold a wanted set and which cells want it; a false hit sends a set that nobody asks
    for. A task holds the sets of one cell. With ``spanning``, pairs that other pairs of the cell have connected already are
    neither tested nor given.
    """
    ends = written(pairs.select(F.col("a").alias("id"), F.col("a_n").alias("n")).union(pairs.select("b", "b_n")).distinct(), "ends")
    blocks = max(MIN_BLOCKS, -(-(ends.agg(F.sum("n")).first()[0] or 0) // tokens))  # one row
    block = lambda c: F.pmod(F.shiftright(c, 25), F.lit(blocks))
    rows = bit_table(ends.join(nodes, "id").select("least.h"), "h")
    drop_tables(ends)
    key = lambda x, y: F.col(x).bitwiseXOR(block(y) * F.lit(SPREAD).cast("long")).alias("h")
    cells = bit_table(pairs.select(key("a", "b")).union(pairs.select(key("b", "a"))), "h")

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["cell", "kind", "a", "b", "a_n", "b_n", "data"]
        others = np.arange(blocks, dtype=np.int64)
        seen: set[int] = set()

        def batch_of(out: list):
            cell, ids, sizes, data = zip(*out, strict=True) if out else ((),) * 4
            none = pa.nulls(len(cell), pa.int64())
            return pa.record_batch([pa.array(cell, pa.int64()), pa.array([0] * len(cell), pa.int32()), pa.array(ids, pa.int64()), none, pa.array(sizes, pa.int64()), none, pa.array(data, pa.binary())], names)

        for batch in batches:
            out, held = [], 0
            hit = in_table(rows.value, batch.column(0).to_numpy())
            for text in batch.column(1).filter(pa.array(hit)).to_pylist():
                s = shingles(text, k)
                if not len(s) or (i := set_id(s)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(i)
                data, own = pack(s), (i >> 25) % blocks
                for j in others[in_table(cells.value, np.int64(i) ^ (others * np.int64(SPREAD)))].tolist():
                    out.append((min(own, j) * blocks + max(own, j), i, len(s), data))
                    held += len(data)
                if held > 2_000_000:
                    yield batch_of(out)
                    out, held = [], 0
            yield batch_of(out)

    p, q = block("a"), block("b")
    asked = pairs.select((F.least(p, q) * blocks + F.greatest(p, q)).alias("cell"), F.lit(1).alias("kind"), "a", "b", "a_n", "b_n", F.lit(None).cast("binary").alias("data"))
    sets = source.select("h", "text").mapInArrow(make, "cell long, kind int, a long, b long, a_n long, b_n long, data binary")
    dealt = sets.unionByName(asked).repartition(_partitions(pairs), "cell").sortWithinPartitions("cell", "kind")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        here, held = None, {}
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for batch in batches:
            cell, kind, a, b = (batch.column(c).to_pylist() for c in range(4))
            data, keep = batch.column(6), np.zeros(len(cell), bool)
            for r in range(len(cell)):
                if cell[r] != here:
                    here, held, parent = cell[r], {}, {}
                if kind[r] == 0:
                    if a[r] not in held:
                        held[a[r]] = unpack(data[r].as_py())
                elif not spanning or (x := root(a[r])) != (y := root(b[r])):
                    keep[r] = test(held[a[r]], held[b[r]])
                    if spanning and keep[r]:
                        parent[x] = y
            yield batch.select(["a", "b", "a_n", "b_n"]).filter(pa.array(keep))

    return dealt.mapInArrow(run, "a long, b long, a_n long, b_n long")


def _verified(pairs: DataFrame, source: DataFrame, nodes: DataFrame, heavy, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b, a_n, b_n) that pass fine bitmaps, then the other orders, then the exact test: enough to connect all ends that
    such pairs connect."""
    packed_bits = lambda s: len(s).to_bytes(8, "little") + fine_bitmap(s).tobytes()
    opened_bits = lambda d: (int.from_bytes(d[:8], "little"), np.frombuffer(d, np.uint64, offset=8))
    opened_set = lambda d: _Set(np.frombuffer(d, np.uint64), heavy.value, num, den)
    likely = written(_met(pairs, source, nodes, k, FINE_CELL, packed_bits, opened_bits, lambda x, y: alike(x, y, num, den)), "likely")
    links = written(_met(likely, source, nodes, k, CELL, lambda s: s.tobytes(), opened_set, lambda x, y: similar(x, y, num, den), True), "links")
    drop_tables(likely)
    return links


def components(edges: DataFrame) -> DataFrame:
    """id and root (the least id of its component) of every end of ``edges`` (a, b).

    Least-label spreading with pointer jumping; each round is a written table, so any executor can be lost.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("id"), "root"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("far"))
        moved = labels.join(jump, "root").join(near, labels["id"] == near["a"], "left")
        following = written(moved.select(labels["id"], F.least("root", "far", "near").alias("root"), (F.least("far", "near") < F.col("root")).alias("moved")), "labels")
        drop_tables(labels)
        if following.where("moved").isEmpty():
            drop_tables(both)
            return following
        labels = following


def classes(docs: DataFrame, key: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """key, h (a hash of key and text), n and ``least`` (key and h of the first row of the component; null without shingles)
    of every row, as a written table."""
    spark = docs.sparkSession
    source = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text")).withColumn("h", F.xxhash64("key", "text"))
    survey = written(_survey(source, k), "survey")
    rows = survey.where("kind = 0").select("key", "h", "id", "n")
    top = survey.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(HEAVY).toPandas()  # HEAVY rows at most
    order = np.argsort(top["id"].to_numpy(np.int64).view(np.uint64))
    heavy = spark.sparkContext.broadcast((top["id"].to_numpy(np.int64).view(np.uint64)[order], top["n"].to_numpy(np.int64)[order]))
    first_row = F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "h")).alias("least")
    nodes = written(rows.where("id IS NOT NULL").groupBy("id").agg(first_row), "nodes")

    lists = written(_lists(_postings(source.select("text"), heavy, k, num, den), heavy, num, den), "lists")
    pairs = lists.where("hub IS NOT NULL").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    pairs = written(pairs.distinct(), "pairs")
    stars = written(_sifted(pairs, survey, num, den), "stars")
    linked = _verified(stars, source, nodes, heavy, k, num, den)
    first = components(linked)

    # Lists with several components left.
    # Roots are looked up once a set, not once a posting; a set has as many postings as its prefix has tokens.
    owned = lists.where("more > 0").groupBy("id").agg(F.first("n").alias("n"), F.collect_list(F.struct("token", "pos", "more")).alias("postings"))
    placed = owned.join(first.select("id", "root"), "id", "left").select(F.coalesce("root", "id").alias("root"), "id", "n", F.inline("postings"))
    placed = written(placed.select("token", "root", "id", "n", "pos", "more"), "placed")
    far = placed.where("more = 2").drop("more")
    thin, thin_lists = _long_pairs(far, survey, num, den, True)
    spans = written(thin.distinct(), "spans")
    near = _short_pairs(placed.where("more = 1"), num, den)
    cross = written(near.union(spans).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti"), "cross")
    drop_tables(lists, thin_lists)
    final, used = first, [pairs, stars, placed, spans, cross, linked]

    def joined(candidates: DataFrame) -> DataFrame:
        """The components with the links among the candidates added."""
        nonlocal linked
        if candidates.isEmpty():
            return final
        sifted = written(_sifted(candidates, survey, num, den), "cross-sifted")
        more = _verified(sifted, source, nodes, heavy, k, num, den)
        used.extend([sifted, more])
        if more.isEmpty():
            return final
        linked = linked.union(more)
        return components(linked)

    final = joined(cross)
    if not spans.isEmpty():
        # What a forest left out lies between components that it touched.
        touched = far.join(_ends(spans).distinct(), "id", "left_semi").select("root").distinct()
        apart = far.join(touched, "root", "left_semi").withColumnRenamed("root", "old").join(final.select("id", "root"), "id", "left")
        apart = written(apart.select("token", F.coalesce("root", "old").alias("root"), "id", "n", "pos"), "apart")
        every, every_lists = _long_pairs(apart, survey, num, den, False)
        tested = stars.select("a", "b").union(cross)
        rest = written(every.distinct().join(tested, ["a", "b"], "left_anti"), "rest")
        drop_tables(apart, every_lists)
        used.append(rest)
        final = joined(rest)
    drop_tables(*used)

    named = nodes.join(final, "id", "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("least"))
    answer = named.select("id", "root").join(lowest, "root").select("id", "least")
    out = written(rows.join(answer, "id", "left").select("key", "h", "n", "least"), "classes")
    drop_tables(survey, nodes)
    return out


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """key, n_shingles and component_id (the least key of the documents reachable by links) of every row of ``docs``.

    Two documents link when ``den * |intersection| >= num * |union|``.
    """
    return classes(docs, key, text, k, num, den).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least.key", "key").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without shingles, and of each component the first row.

    Rows are told by a hash of id and text. Those that a bit table of the hashes that go or repeat clears are kept where they
    are; the others alone are shuffled to an exact join.
    """
    found = classes(docs, key, text, k, num, den)
    judged = found.where("least IS NOT NULL").groupBy("h").agg(F.max(F.col("h") != F.col("least.h")).alias("gone"), F.count(F.lit(1)).alias("times"))
    judged = written(judged.where("gone OR times > 1").select(F.col("h").alias("of"), "gone"), "judged")
    drop_tables(found)
    bits = bit_table(judged, "of")
    rows, names = hidden(docs)
    marked = rows.withColumn("h", F.xxhash64(F.col(names[key]).cast("long"), F.col(names[text]).cast("string")))

    def part(hit: bool) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                yield batch.filter(pa.array(in_table(bits.value, batch.column(batch.num_columns - 1).to_numpy()) == hit))

        return marked.mapInArrow(run, marked.schema)

    doubtful = part(True).join(judged, F.col("h") == F.col("of"), "left")
    sure, again = doubtful.where("gone IS NULL"), doubtful.where("NOT gone").dropDuplicates(["h"])
    return part(False).select(*shown(names)).unionByName(sure.unionByName(again).select(*shown(names)))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
