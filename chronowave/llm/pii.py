"""PII: base patterns, and candidate spans selected by gradient-boosted trees.

Base spans (email, ip, card, phone) always stay. High-recall generators propose further, overlapping candidates with kinds
of their own; boosted trees score them from format and context features; a logistic calibration and a threshold for each kind,
the best on held-out rows, select.
The trees are trained on the driver from a small generated table, once a session, and are one constant array in the plan, so
the main path is one native projection over whole texts.

Positions come from the pieces between matches (``split``) and the matches (``regexp_extract_all``), both found by the same
scan, by running totals; lengths count code points, and bytes for cutting. A text of ``n`` matches costs ``n ** 1.5``. No generator of open-ended secrets bounds their length. Patterns are written possessive or anchored at run starts, with equal matches, so that long
runs of digits or letters cost linear time and no stack.

Defined results: null and empty texts have no spans (the hash of an empty string); overlapping spans of different base kinds
all stay, and candidates are scored and kept whether they overlap them or not; candidates over
the threshold are chosen by falling probability (then longer, then first) where they overlap none chosen before, and redaction
covers the others too; repeated rows are judged each; an empty table stays empty.
"""

from __future__ import annotations

import math
import random
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hidden, let, once, shown, table


class Kind(NamedTuple):
    name: str
    pattern: str
    gate: str  # a cheap pattern that every text with a match also matches


#: An address may start only where a run of its letters does, or where the last match ended.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
#: High-recall generators of further kinds.
GENERATORS = (
    Kind("secret", r"(?i)(?:token|passw(?:or)?d|pwd|secret|api[_-]?key|access[_-]?key|key)\x20?[=:]\x20?\"?[A-Za-z0-9_/+.-]{6,}+\"?", r"[=:]"),
    Kind("secret", r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])", r"A[KS]IA"),
    Kind("secret", r"(?<![A-Za-z0-9])(?=[A-Z0-9]*[0-9])[A-Z]{2,4}[A-Z0-9]{12,}+(?![A-Za-z0-9])", r"[A-Z]{2}[A-Z0-9]{12}"),
    Kind("secret", r"(?<![A-Za-z0-9])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,}+(?![A-Za-z0-9])", r"[0-9a-f]{16}"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    Kind("local_phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    Kind("spelt_email", r"(?i)(?<![A-Za-z0-9])[A-Za-z0-9._-]{2,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,64}(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z]{2,12}", r"(?i)[\[(]at[\])]"),
)
#: Code points and bytes from the beginning; ``rank`` is the kind's place in the lists.
SPAN = "struct<start:int,rank:int,end:int,kind:string,match:string,before:string,at:int,upto:int>"
SCORED = "struct<start:int,end:int,rank:int,kind:string,p:double>"
LIKELY = "struct<start:int,end:int,rank:int,kind:string,p:double,at:int,upto:int>"
CONTEXT, BLOCK, DEPTH = 24, 64, 3


def running(values: Column, op=lambda a, b: a + b) -> Column:
    """The running totals of an array of longs from 0 under ``op``, by blocks: array expressions copy what they extend, so one
    fold over ``n`` values would cost ``n`` squared; blocks of the root of ``n`` cost ``n ** 1.5``."""

    def fold(block: Column) -> Column:
        return F.aggregate(block, F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x)))

    def cut(v: Column, size: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / size).cast("int") - 1, F.lit(0)))
        return F.transform(firsts, lambda k: fold(F.slice(v, k * size + 1, size)))

    def joined(blocks: Column) -> Column:
        before = fold(F.transform(blocks, lambda f: F.element_at(f, -1)))
        return let(before, lambda o: F.flatten(F.transform(blocks, lambda f, k: F.transform(F.slice(f, F.lit(2), F.size(f) - 1), lambda x: op(F.get(o, k), x)))))

    return let(values, lambda v: let(F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(v))).cast("int")), lambda size: let(cut(v, size), joined)))


def _matches(text: Column, kind: Kind, rank: int) -> Column:
    """Array of the spans of a pattern; empty where the gate doesn't match. ``before`` is the text that precedes, back to the
    beginning of the match before."""

    def spans(found: Column, between: Column) -> Column:
        both = lambda t: F.shiftleft(F.length(t).cast("long"), 32) + F.octet_length(t)  # noqa: E731  code points and bytes
        steps = F.transform(found, lambda m, i: both(F.get(between, i)) + F.coalesce(both(F.get(found, i - 1)), F.lit(0)))

        def span(m: Column, i: Column, place: Column) -> Column:
            start, at = F.shiftright(place, 32).cast("int"), place.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
            before = F.right(F.concat(F.coalesce(F.right(F.get(found, i - 1), F.lit(CONTEXT)), F.lit("")), F.get(between, i)), F.lit(CONTEXT))
            return F.struct(
                start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(m)).alias("end"), F.lit(kind.name).alias("kind"), m.alias("match"),
                before.alias("before"), at.alias("at"), (at + F.octet_length(m)).alias("upto"),
            )

        return let(running(steps), lambda places: F.transform(found, lambda m, i: span(m, i, F.get(places, i))))

    whole = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda found: let(F.split(text, kind.pattern, -1), lambda between: spans(found, between)))
    return F.when(F.rlike(text, F.lit(kind.gate)), whole.cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))


def luhn(digits: Column) -> Column:
    at = lambda i: F.reverse(digits).substr(i, F.lit(1)).cast("int")
    doubled = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), lambda i: F.when(i % 2 == 1, at(i)).when(at(i) > 4, 2 * at(i) - 9).otherwise(2 * at(i)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans, sorted by start, then kind as listed."""
    valid = lambda name: lambda s: _valid(name, s["match"])
    return F.sort_array(F.concat(*[F.filter(_matches(text, k, i), valid(k.name)) for i, k in enumerate(BASE)]))


# --- the boosted selection -------------------------------------------------------------------------------------------

#: Feature names and expressions on the candidate, its kind, and the text before it.
FEATURES = {
    "n": lambda m, k, c: F.length(m),
    "digits": lambda m, k, c: F.length(F.regexp_replace(m, "[^0-9]", "")),
    "uppers": lambda m, k, c: F.length(F.regexp_replace(m, "[^A-Z]", "")),
    "hexes": lambda m, k, c: F.length(F.regexp_replace(m, "[^0-9a-f]", "")),
    "assigned": lambda m, k, c: F.rlike(m, F.lit("[=:]")).cast("int"),
    "spaces": lambda m, k, c: F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))),
    "keyword": lambda m, k, c: F.rlike(c, F.lit("(?i)(token|passw|secret|key|ssn|social|iban|account|phone|call|tel|mail|id)[^A-Za-z]*$")).cast("int"),
    "denied": lambda m, k, c: F.rlike(c, F.lit("(?i)(version|commit|sha|md5|checksum|build|isbn|order|serial|part|revision)[^A-Za-z]*$")).cast("int"),
    "prefixed": lambda m, k, c: F.rlike(m, F.lit("^A[KS]IA")).cast("int"),
    "repeats": lambda m, k, c: F.rlike(m, F.lit(r"(.)\1{5}")).cast("int"),
}
KINDS = ("secret", "national_id", "iban", "local_phone", "spelt_email")


def _featurize(match: str, kind: str, before: str) -> list[float]:
    """The same features in Python, for the generated training table; ``tests/llm`` holds them against the expressions."""
    import re

    count = lambda pattern: len(re.findall(pattern, match))
    near = lambda names: float(bool(re.search(rf"(?i)({names})[^A-Za-z]*$", before)))
    return [
        len(match), count("[0-9]"), count("[A-Z]"), count("[0-9a-f]"), float(bool(re.search("[=:]", match))), match.count(" "),
        near("token|passw|secret|key|ssn|social|iban|account|phone|call|tel|mail|id"), near("version|commit|sha|md5|checksum|build|isbn|order|serial|part|revision"),
        float(bool(re.match("A[KS]IA", match))), float(bool(re.search(r"(.)\1{5}", match))), *[float(kind == k) for k in KINDS],
    ]


def training_table(seed: int = 7, n: int = 60) -> tuple[list[list[float]], list[int]]:
    """A small generated table of candidates: forms of personal data and secrets, and forms that only look like them."""
    r = random.Random(seed)
    some = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    hexa, alnum, up, dig = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789"
    word = lambda: some("abcdefghijklmnoprstu", r.randint(3, 9))
    yes, no = [], []
    for _ in range(n):
        plain = f"{word()} {word()} "
        yes += [
            (f'token = "{some(hexa, r.choice((32, 40, 64)))}"', "secret", plain), (f"password={some(alnum, r.randint(8, 24))}{r.randint(0, 9)}", "secret", plain),
            (f"secret: {some(hexa, 18)}7", "secret", plain), ("AKIA" + some(r.choice((up, up[:26])), 16), "secret", plain), (f"api_key={some(alnum, 32)}1", "secret", plain), (some(hexa, 40), "secret", plain + "token "),
            (f"{some(dig, 3)}-{some(dig, 2)}-{some(dig, 4)}", "national_id", plain), (f"{some(dig, 3)}-{some(dig, 2)}-{some(dig, 4)}", "national_id", "ssn "),
            (f"DE{some(dig, 20)}", "iban", plain), (f"GB{some(dig, 2)} {some(up, 4)} {some(dig, 4)} {some(dig, 4)} {some(dig, 2)}", "iban", plain + "iban "),
            (f"({some(dig, 3)}) {some(dig, 3)}-{some(dig, 4)}", "local_phone", plain), (f"{some(dig, 3)}-{some(dig, 3)}-{some(dig, 4)}", "local_phone", "call "),
            (f"{word()} [at] {word()} [dot] com", "spelt_email", plain),
        ]
        no += [
            (f"key: {word()}", "secret", plain), (f"token = {word()}", "secret", plain), (f"secret: {word()}{word()}", "secret", plain), (some(hexa, 40), "secret", plain + "commit "), (some(hexa, 32), "secret", "md5 "),
            (some("ABCDEFGHIJ", 15) + "1", "secret", plain + "part "), ("0" * 30 + "a1", "secret", plain), ("ISO" + "1" * 14, "secret", "order "), (f"{some(dig, 3)}-{some(dig, 2)}-{some(dig, 4)}", "national_id", "isbn "),
            (f"{some(dig, 3)}-{some(dig, 2)}-{some(dig, 4)}", "national_id", "part "), (f"AB{some(dig, 14)}", "iban", "serial "), (f"{some(dig, 3)}.{some(dig, 3)}.{some(dig, 4)}", "local_phone", "version "), (f"{some(dig, 3)} {some(dig, 3)} {some(dig, 4)}", "local_phone", "order "),
        ]
    rows = yes + no
    return [_featurize(*x) for x in rows], [1] * len(yes) + [0] * len(no)


class Tree(NamedTuple):
    """A regression tree: a leaf has a value, a node sends rows with ``feature <= cut`` to the left."""

    feature: int = -1
    cut: float = 0.0
    left: Tree | None = None
    right: Tree | None = None
    value: float = 0.0


class Boosted(NamedTuple):
    trees: tuple[Tree, ...]
    slope: float
    shift: float
    thresholds: dict[str, float]

    def probability(self, row: list[float]) -> float:
        margin = sum(_leaf(t, row) for t in self.trees)
        return 1 / (1 + math.exp(-(margin * self.slope + self.shift)))


def _leaf(t: Tree, row: list[float]) -> float:
    while t.left is not None:
        t = t.left if row[t.feature] <= t.cut else t.right
    return t.value


def best_threshold(p: list[float], y: list[int]) -> float:
    """The cut with the best F1 on held-out rows; of the cuts that tie, the middle of the range nearest to 0.5."""
    cuts = sorted({0.0, *p, 1.0})
    ranges = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        at = (low + high) / 2
        hit = sum(b for a, b in zip(p, y, strict=True) if a >= at)
        f1 = 2 * hit / max(1, sum(a >= at for a in p) + sum(y))
        ranges.append((-f1, abs(at - 0.5), at))
    return min(ranges)[2] if ranges else 0.5


def train_boosted(rounds: int = 30, depth: int = DEPTH, rate: float = 0.4) -> Boosted:
    """Newton boosting of logistic loss; then, on rows that boosting doesn't see, a logistic calibration (every fourth row)
    and each kind's threshold (every other fourth row)."""
    import numpy as np

    rows, labels = training_table()
    x, y = np.array(rows), np.array(labels, float)
    part = np.random.default_rng(3).permutation(len(y)) % 4
    fit, held = part >= 2, part == 0

    def grow(at, g, h, d):
        value = -g[at].sum() / (h[at].sum() + 1.0)
        best = (1e-6, None)
        if d:
            for f in range(x.shape[1]):
                for cut in np.unique(x[at, f])[:-1]:
                    left, right = at[x[at, f] <= cut], at[x[at, f] > cut]
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (left, right)) - g[at].sum() ** 2 / (h[at].sum() + 1.0)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, float(cut), left, right))
        if best[1] is None:
            return Tree(value=float(rate * value))
        f, cut, left, right = best[1]
        return Tree(f, cut, grow(left, g, h, d - 1), grow(right, g, h, d - 1))

    score, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.flatnonzero(fit), p - y, p * (1 - p), depth))
        score += np.array([_leaf(trees[-1], row) for row in x])
    slope, shift = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(slope * score[held] + shift)))
        slope -= 0.05 * float(((p - y[held]) * score[held]).mean() + 0.01 * (slope - 1))
        shift -= 0.05 * float((p - y[held]).mean())
    p = 1 / (1 + np.exp(-(slope * score + shift)))
    of_kind = lambda k: np.flatnonzero((part == 1) & (x[:, len(FEATURES) + KINDS.index(k)] == 1))
    return Boosted(tuple(trees), slope, shift, {k: best_threshold(p[of_kind(k)].tolist(), y[of_kind(k)].astype(int).tolist()) for k in KINDS})


_TRAINED: list[Boosted] = []


def boosted() -> Boosted:
    if not _TRAINED:
        _TRAINED.append(train_boosted())
    return _TRAINED[0]


def _heap(t: Tree, depth: int) -> tuple[list[tuple[int, float]], list[float]]:
    """Nodes (feature, cut) of a tree in heap order, and the values of its ``2 ** depth`` leaves; where a leaf comes earlier,
    its nodes send every row to the left."""
    level, nodes = [t], []
    for _ in range(depth):
        nodes += [(n.feature, n.cut) if n.left is not None else (0, math.inf) for n in level]
        level = [x for n in level for x in ((n.left, n.right) if n.left is not None else (n, n))]
    return nodes, [n.value for n in level]


def margin(model: Boosted, x: Column, depth: int = DEPTH) -> Column:
    """The sum of all trees' values for an array of features. The trees are one constant array, and a row goes down in ``depth``
    lookups a tree."""
    number = lambda v: "double('Infinity')" if v == math.inf else f"{v!r}D"
    rows = []
    for nodes, values in (_heap(t, depth) for t in model.trees):
        rows.append(f"named_struct('f', array({', '.join(str(f) for f, _ in nodes)}), 'c', array({', '.join(number(c) for _, c in nodes)}), 'v', array({', '.join(map(number, values))}))")

    def leaf(t: Column) -> Column:
        down = lambda i: 2 * i + 1 + (F.get(x, F.get(t["f"], i)) > F.get(t["c"], i)).cast("int")
        step = lambda i, left: F.get(t["v"], i - (2**depth - 1)) if not left else let(down(i), lambda j: step(j, left - 1))
        return step(F.lit(0), depth)

    return F.aggregate(F.expr(f"array({', '.join(rows)})"), F.lit(0.0), lambda total, t: total + leaf(t))


def likely_spans(text: Column, threshold: float | None = None) -> Column:
    """The candidates that the trees put over their kind's threshold (or over a given one), by start; base spans drop none, as
    the rest of a secret around one is a secret."""
    model = boosted()
    limits = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit(model.thresholds[k] if threshold is None else threshold))])

    def scored(c: Column) -> Column:
        features = F.array(*[f(c["match"], c["kind"], c["before"]).cast("double") for f in FEATURES.values()], *[(c["kind"] == k).cast("double") for k in KINDS])
        p = 1 / (1 + F.exp(-(let(features, lambda v: margin(model, v)) * model.slope + model.shift)))
        return F.struct(*[c[n].alias(n) for n in ("start", "end", "rank", "kind")], p.alias("p"), c["at"].alias("at"), c["upto"].alias("upto"))

    kinds = [_matches(text, k, len(BASE) + KINDS.index(k.name)) for k in GENERATORS]
    likely = lambda c: F.sort_array(F.filter(F.transform(c, scored), lambda s: s["p"] >= F.element_at(limits, s["kind"])))
    return let(F.concat(*kinds), lambda c: F.when(F.size(c) > 0, likely(c)).otherwise(F.array().cast(f"array<{LIKELY}>")))


def _fresh(spans: Column, end: str) -> Column:
    """Positions, from 0, of spans (by start) that begin at or after the end of all before them, and the number of spans."""
    start = {"end": "start", "upto": "at"}[end]
    ends = running(F.transform(spans, lambda s: s[end].cast("long")), F.greatest)
    places = lambda e: F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)[start] >= F.get(e, i - 1)))
    return F.concat(let(ends, places), F.array(F.size(spans)))


def chosen(likely: Column, of: str = SCORED) -> Column:
    """Of spans by start, those that overlap none chosen before, by falling probability, then length, then start.

    Spans that overlap in a chain form a group, and each group is chosen from by itself.
    """
    none = F.array().cast(f"array<{of}>")

    def choose(group: Column) -> Column:
        order = F.sort_array(F.transform(group, lambda s: F.struct((-s["p"]).alias("q"), (s["start"] - s["end"]).alias("n"), s.alias("s"))))
        clash = lambda kept, s: F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
        return F.aggregate(order, none, lambda kept, r: F.when(clash(kept, r["s"]), kept).otherwise(F.array_append(kept, r["s"])))

    def groups(first: Column) -> Column:
        return F.transform(F.slice(first, F.lit(1), F.size(first) - 1), lambda a, i: F.slice(likely, a + 1, F.get(first, i + 1) - a))

    kept = let(_fresh(likely, "end"), lambda first: F.flatten(F.transform(groups(first), lambda g: F.when(F.size(g) > 1, choose(g)).otherwise(g))))
    return F.when(F.size(likely) > 1, F.sort_array(kept)).otherwise(likely)


PLAIN = "struct<start:int,rank:int,end:int,kind:string,at:int,upto:int>"


def _searched(docs: DataFrame, text: str, threshold: float | None) -> tuple[DataFrame, dict[str, str]]:
    """The hidden columns of ``docs``, ``t`` (the text) and ``p``: base spans, all candidates over the threshold and the chosen
    ones, computed once per row."""
    rows, names = hidden(docs)
    named = rows.withColumn("t", F.coalesce(F.col(names[text]).cast("string"), F.lit("")))
    plain = lambda a: F.transform(a, lambda s: F.struct(*[s[n].alias(n) for n in ("start", "rank", "end", "kind", "at", "upto")])).cast(f"array<{PLAIN}>")
    # Texts without a digit, an "@", an assignment or a spelt-out sign have nothing to find.
    both = let(likely_spans(F.col("t"), threshold), lambda c: F.struct(plain(base_spans(F.col("t"))).alias("base"), plain(c).alias("likely"), plain(chosen(c, LIKELY)).alias("more")))
    return once(named, "p", both), names


def find_pii(docs: DataFrame, text: str = "text", threshold: float | None = None) -> DataFrame:
    """``docs`` with ``base`` (base spans) and ``found`` (all spans, by start, then kind as listed), in place of any columns of
    these names, computed once per row."""
    searched, names = _searched(docs, text, threshold)
    return searched.select(*shown(names, "base", "found"), F.col("p.base").alias("base"), F.sort_array(F.concat("p.base", "p.more")).alias("found"))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text: str = "text", threshold: float | None = None) -> DataFrame:
    """``docs`` with base spans and all candidates over the threshold replaced by their kind in brackets.

    Overlapping spans become one, named by the first. Pieces are cut from the text's bytes, whatever their number.
    """
    searched, names = _searched(docs, text, threshold)
    data = F.col("t").cast("binary")

    def clean(spans: Column) -> Column:
        piece = lambda d, a, b: F.substring(d, a + 1, b - a).cast("string")

        def parts(first: Column, ends: Column, d: Column) -> Column:
            def part(a: Column, i: Column) -> Column:
                before = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, a - 1)).cast("int")
                return F.concat(piece(d, before, F.get(spans, a)["at"]), F.lit("["), F.get(spans, a)["kind"], F.lit("]"))

            return F.concat(F.transform(F.slice(first, F.lit(1), F.size(first) - 1), part), F.array(piece(d, F.element_at(ends, -1).cast("int"), F.octet_length(d))))

        ends = running(F.transform(spans, lambda s: s["upto"].cast("long")), F.greatest)
        return F.array_join(let(_fresh(spans, "upto"), lambda first: let(ends, lambda e: let(data, lambda d: parts(first, e, d)))), "")

    spans = F.sort_array(F.concat("p.base", "p.likely"))
    value = let(spans, lambda s: F.when(F.size(s) > 0, clean(s)).otherwise(F.col(names[text]).cast("string")))
    return searched.withColumn("clean", value).select(*[F.col("clean").alias(c) if c == text else column for c, column in zip(names, shown(names), strict=True)])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    is_kind = lambda name: lambda s: s["kind"] == name
    counts = [F.size(F.filter("base", is_kind(k.name))).cast("long").alias(f"n_{k.name}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
