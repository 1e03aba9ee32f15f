"""Personal data and secrets by boosted trees over candidate spans, in DataFrame functions only.

Generators of high recall propose overlapping spans of five kinds: the base patterns; narrower ones that find an address or
number inside what a greedy base pattern joined with its neighbours and then dropped; mail addresses that are spelled out;
phone numbers without country code; values that a key word announces as secret; and long runs of letters and digits.
Format and context features describe a candidate; their combinations (FEATURES lists small ranges) are counted over all
documents, and boosted regression trees are fitted on the driver to these counts.

Examples are the base spans, and other candidates that two independent signs confirm (``_sure``): a checksum or an unlikely
format on one side, an announcing word or the grouping on the other. All other candidates apart from base spans are
counterexamples, many of them really unlabelled; so an example that a word announces counts a second time with that word
masked. A format that announced candidates share with few others thus scores high without the word, and one that most
candidates have unannounced scores low. A fifth of the documents calibrates, for each kind, the lowest score whose
candidates are confirmed often enough (where that fifth confirms none of a kind, all documents do); candidates from that
score on are added where they overlap no base span. The trees become one column expression.

Patterns use loops over single characters (and loops of bounded length), and start where a run starts, so a text of any
length needs linear time and no stack: separators between two digits (or dots inside a domain) are first replaced by a
private character, one for one, which keeps offsets. Offsets are code points, end exclusive.

Defined results: a null text is like an empty one, without spans; repeated rows have spans each; without candidates, or
without examples of both kinds, only base spans are returned; an empty table gives an empty table;
input columns are kept, but one that has an added column's name is replaced (redacting returns the input's columns).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import besides, materialise, own_names, plain_names

#: Fixed value: the kinds, in the order of reports; the last one has no base pattern.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Trees, their depth, the step of each, and the least number of candidates in a leaf.
TREES, DEPTH, STEP, LEAF = 30, 3, 0.3, 2
#: From this share of confirmed candidates on, as calibrated, spans are added; and at least at this score.
PRECISION, LEAST_SCORE = 0.9, 0.5
#: Small categories that describe a candidate, each clipped to the range below its bound.
FEATURES = {"kind": 5, "digits": 25, "groups": 8, "plus": 2, "brackets": 2, "dots": 6, "luhn": 2, "octets": 2, "shape": 5, "size": 4, "before": 4, "after": 4, "hint": 2}

_MARK = "\ue000"
_LOCAL, _DOMAIN = "A-Za-z0-9._%+\\-", "A-Za-z0-9\\-"
_EMAIL = f"(?:(?<![{_LOCAL}{_MARK}])|\\G)[{_LOCAL}{_MARK}]++@[{_DOMAIN}]++{_MARK}[{_DOMAIN}{_MARK}]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = f"[0-9][0-9{_MARK}]*[0-9]"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Narrower generators.
_IP_ALONE = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])"
_CARD_ALONE = r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4})(?![0-9])"
_PHONE_ALONE = r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"
_PHONE_LOCAL = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
_AT, _DOT = r"\x20?[\[({<]\x20?at\x20?[\])}>]\x20?", r"\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?"
_NAME = f"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}"
_EMAIL_MARKED = f"(?i){_NAME}{_AT}[{_DOMAIN}]{{1,63}}(?:(?:{_DOT}|\\.)[{_DOMAIN}]{{2,24}}){{1,3}}"
_EMAIL_SPOKEN = f"(?i){_NAME}\\x20at\\x20[{_DOMAIN}]{{1,63}}(?:\\x20dot\\x20[{_DOMAIN}]{{2,24}}){{1,3}}"
_KEYS = r"token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer"
_TOLD = r"[\x22\x27]?[\x20\t]{0,4}(?::=|=>|[:=]|is\b)[\x20\t]{0,4}[\x22\x27]?"
_KEYED = f"(?i)(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{{0,24}}(?:{_KEYS}){_TOLD}[^\\s\\x22\\x27,;<>]{{6,}}+"
_KEY = f"(?i)^[A-Za-z0-9_-]*?(?:{_KEYS}){_TOLD}"
_LONG = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{24,}+"
#: What every match of these generators has, as lowered text.
_KEY_MARKS = ("token", "secret", "passw", "passphrase", "pwd", "key", "credential", "bearer")
_SPOKEN_MARKS = (" dot ", "(at", "[at", "{at", "<at", "( at", "[ at", "{ at", "< at")
#: Words shortly before a span that announce one of its kind.
_HINTS = ("mail|contact|write|reach", "address|addr|host|server|\\bip\\b", "card|visa|pay|credit", "phone|tel|call|fax|mobile|cell", _KEYS)

_SPAN = "struct<s:int,e:int,kind:int,base:boolean,sure:boolean,f:array<int>>"


def _let(value: str, name: str, body: str) -> str:
    """body with value bound to the name, so that it is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _quoted(pattern: str) -> str:
    return f"r'{pattern}'"


def _before(values: str, zero: int, merge: Callable[[str, str], str]) -> str:
    """What merging all values before each gives: by blocks, so that long arrays cost little more than their length."""
    n, none = 64, "cast(array() AS array<int>)"

    def running(array: str, first: str) -> str:
        return f"aggregate({array}, named_struct('p', {first}, 'o', {none}), (s, x) -> named_struct('p', cast({merge('s.p', 'x')} AS int), 'o', array_append(s.o, s.p)), s -> s.o)"

    whole = f"transform(bs, b -> aggregate(b, {zero}, (s, x) -> cast({merge('s', 'x')} AS int)))"
    of = f"flatten(zip_with(bs, {running(whole, str(zero))}, (b, first) -> {running('b', 'first')}))"
    blocks = f"transform(sequence(0, cast(floor((size(vs) - 1) / {n}) AS int)), k -> slice(vs, k * {n} + 1, {n}))"
    return _let(values, "vs", f"CASE WHEN size(vs) > 0 THEN {_let(blocks, 'bs', of)} ELSE {none} END")


def _with_near(candidates: str) -> str:
    """Candidates by start, each with whether another one is a base span that holds and overlaps it."""
    last = 2**31 - 1
    ends = _before("transform(cs, c -> CASE WHEN c.base THEN c.e ELSE -1 END)", -1, lambda a, b: f"greatest({a}, {b})")
    starts = _before(f"reverse(transform(cs, c -> CASE WHEN c.base THEN c.s ELSE {last} END))", last, lambda a, b: f"least({a}, {b})")
    near = f"zip_with({ends}, reverse({starts}), (e, s) -> named_struct('e', e, 's', s))"
    fields = ", ".join(f"'{k}', c.{k}" for k in ("s", "e", "kind", "base", "sure"))
    return _let(f"array_sort({candidates})", "cs", f"zip_with(cs, {near}, (c, n) -> named_struct({fields}, 'near', n.e > c.s OR n.s < c.e, 'f', c.f))")


def _class(char: str) -> str:
    """0 none, 1 space, 2 letter or digit, 3 other."""
    return f"CASE WHEN coalesce({char}, '') = '' THEN 0 WHEN {char} RLIKE r'^\\s' THEN 1 WHEN {char} RLIKE r'^[\\p{{L}}\\p{{N}}]' THEN 2 ELSE 3 END"


def _octets(text: str) -> str:
    part = "^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
    return f"(size(split({text}, r'\\.')) = 4 AND forall(split({text}, r'\\.'), p -> p RLIKE {_quoted(part)}))"


def _shape(text: str) -> str:
    """0 without letters, 1 letters alone, 2 digits and hexadecimal letters, 3 digits and letters, 4 with other characters."""
    return f"CASE WHEN NOT {text} RLIKE '[A-Za-z]' THEN 0 WHEN {text} RLIKE '[^A-Za-z0-9]' THEN 4 WHEN NOT {text} RLIKE '[0-9]' THEN 1 WHEN {text} RLIKE '^(?:[0-9a-f]+|[0-9A-F]+)$' THEN 2 ELSE 3 END"


def _valid(kind: int, n: str, plain: str, luhn: str) -> str:
    """The base rules of a kind; n: the number of digits."""
    return ("true", _octets(plain), f"({n} BETWEEN 16 AND 19 AND {luhn})", f"{n} BETWEEN 8 AND 15")[kind]


def _sure(kind: int, n: str, piece: str, v: dict[str, str]) -> str:
    """Whether two independent signs confirm a candidate that is no base span."""
    marked = _quoted(f"(?i){_AT}.*(?:{_DOT}|[.])")
    return (
        f"({v['hint']} OR {piece} RLIKE {marked})",
        f"({v['octets']} AND {v['hint']})",
        f"({n} BETWEEN 13 AND 19 AND {v['luhn']} AND ({v['hint']} OR {v['groups']} = 4))",
        f"({n} BETWEEN 7 AND 15 AND {v['hint']})",
        f"({v['hint']} AND (({v['shape']} >= 2 AND length({piece}) >= 8) OR length({piece}) >= 24))",
    )[kind]


def _candidates(text: str, kind: int, pattern: str, base: bool, head: str | None = None) -> str:
    """The matches of one generator with their features. head: what of a match announces the span and is no part of it."""
    match, gap, after = "found.m[i]", "found.g[i]", "found.g[i + 1]"
    told = "''" if head is None else f"regexp_extract({match}, {_quoted(head)}, 0)"
    piece = match if head is None else f"substring({match}, length({told}) + 1)"
    before = f"right({gap}, 28)" if head is None else f"concat(right({gap}, 28), {told})"
    plain = f"replace({piece}, '{_MARK}', '{'.' if kind == 0 else ''}')" if base else piece
    digits = f"regexp_replace({plain}, '[^0-9]+', '')"
    n, start = f"length({digits})", f"(starts[i] + length({gap}) + length({told}))"
    hint = _quoted(f"(?i)(?:{_HINTS[kind]})[^\\n]{{0,16}}$")
    values = {
        "kind": str(kind), "digits": n, "groups": f"size(split(regexp_replace({piece}, '[^0-9]+$|^[^0-9]+', ''), '[^0-9]+'))", "plus": f"startswith({piece}, '+')", "brackets": f"contains({piece}, '(')", "dots": f"length({piece}) - length(replace({piece}, '.', ''))",
        "luhn": f"({n} BETWEEN 12 AND 19 AND luhn_check(CASE WHEN {n} BETWEEN 12 AND 19 THEN {digits} ELSE '0' END))" if kind == 2 else "false", "octets": _octets(plain) if kind == 1 else "false", "shape": f"({_shape(plain)})" if kind == 4 else "0", "size": f"floor(log2(length({piece}) / 4))",
        "before": _class(f"right({before}, 1)"), "after": _class(f"left({after}, 1)"), "hint": f"({before} RLIKE {hint})",
    }
    valid = _valid(kind, n, plain, values["luhn"]) if base else "false"
    sure = valid if base else _sure(kind, n, piece, values)
    clipped = ", ".join(f"least(greatest(cast({values[k]} AS int), 0), {bound - 1})" for k, bound in FEATURES.items())
    one = f"named_struct('s', cast({start} AS int), 'e', cast({start} + length({piece}) AS int), 'kind', {kind}, 'base', {valid}, 'sure', {sure}, 'f', array({clipped}))"
    sizes = "zip_with(slice(found.g, 1, size(found.m)), found.m, (g, m) -> length(g) + length(m))"
    starts = _let(_before(sizes, 0, lambda a, b: f"{a} + {b}"), "starts", f"transform(sequence(0, size(found.m) - 1), i -> {one})")
    pieces = f"named_struct('m', regexp_extract_all({text}, {_quoted(pattern)}, 0), 'g', split({text}, {_quoted(pattern)}, -1))"
    return _let(pieces, "found", f"CASE WHEN size(found.m) > 0 THEN {starts} ELSE cast(array() AS array<{_SPAN}>) END")


def _any(text: str, marks: tuple[str, ...]) -> str:
    return " OR ".join(f"contains({text}, '{m}')" for m in marks)


def with_candidates(docs: DataFrame, text_col: str = "text", out_col: str = "candidates") -> DataFrame:
    """docs with all candidate spans; base ones that hold are marked. The expression is stated as SQL text, because one of
    so many parts takes long to put together call by call."""
    text = f"coalesce(cast(`{text_col}` AS string), '')"
    clean = f"translate({text}, '{_MARK}', '\ue001')"
    mailed = f"regexp_replace({clean}, {_quoted(f'(?<=[{_DOMAIN}])[.](?=[{_DOMAIN}])')}, '{_MARK}')"
    joined = f"regexp_replace({clean}, r'(?<=[0-9])[\\x20-](?=[0-9])', '{_MARK}')"
    none = f"cast(array() AS array<{_SPAN}>)"

    def where(gate: str, *generators: tuple) -> str:
        return f"CASE WHEN {gate} THEN concat({', '.join(g if isinstance(g, str) else _candidates(*g) for g in generators)}) ELSE {none} END"

    dotted = where(f"{text} RLIKE r'[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]'", (clean, 1, _IP, True), (clean, 1, _IP_ALONE, False))
    numbers = where(f"{text} RLIKE r'[0-9][0-9][^\\n]{{0,12}}[0-9]|[0-9][\\x20-]?[0-9][\\x20-]?[0-9]'", (joined, 2, _CARD, True), (clean, 2, _CARD_ALONE, False), (clean, 3, _PHONE_LOCAL, False))
    plus = where(f"contains({text}, '+')", (clean, 3, _PHONE, True), (clean, 3, _PHONE_ALONE, False))
    long = where(f"{text} RLIKE '[0-9][A-Za-z]|[A-Za-z][0-9]'", (clean, 4, _LONG, False))
    mails = where(f"contains({text}, '@')", (mailed, 0, _EMAIL, True))
    words = _let(f"lower({text})", "low", f"concat({where(_any('low', _SPOKEN_MARKS), (clean, 0, _EMAIL_MARKED, False), (clean, 0, _EMAIL_SPOKEN, False))}, {where(_any('low', _KEY_MARKS), (clean, 4, _KEYED, False, _KEY))})")
    some = f"{text} RLIKE '[0-9]'"
    found = f"{mails}, {where(some, dotted, numbers, plus, long)}, {words}"
    return docs.withColumn(out_col, F.expr(_with_near(f"concat({found})")))


class Trees:
    """Gradient boosting of the logistic loss over weighted rows of small integers."""

    def __init__(self) -> None:
        self.start, self.trees = 0.0, []

    def fit(self, rows: list[tuple[tuple[int, ...], float, float]]) -> Trees:
        """rows: features, weight of positives, weight of negatives."""
        x = np.array([r[0] for r in rows], np.int64).reshape(len(rows), -1)
        pos, neg = (np.array([r[k] for r in rows], float) for k in (1, 2))
        self.start = math.log((pos.sum() + 0.5) / (neg.sum() + 0.5))
        score = np.full(len(rows), self.start)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-score))
            tree = self._grown(x, pos - (pos + neg) * q, (pos + neg) * q * (1 - q), pos + neg, np.arange(len(rows)), DEPTH)
            self.trees.append(tree)
            score = score + self._values(tree, x)
        return self

    def _grown(self, x: np.ndarray, slope: np.ndarray, weight: np.ndarray, count: np.ndarray, at: np.ndarray, depth: int):
        total, mass, best = slope[at].sum(), weight[at].sum(), (1e-6, None)
        for feature, bound in enumerate(FEATURES.values()) if depth else ():
            g, h, n = (np.cumsum(np.bincount(x[at, feature], v[at], bound))[:-1] for v in (slope, weight, count))
            gain = g * g / (h + 1) + (total - g) ** 2 / (mass - h + 1) - total * total / (mass + 1)
            gain[np.minimum(n, count[at].sum() - n) < LEAF] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = gain[k], (feature, k)
        if best[1] is None:
            return float(STEP * total / (mass + 1))
        feature, value = best[1]
        low = x[at, feature] <= value
        return feature, value, self._grown(x, slope, weight, count, at[low], depth - 1), self._grown(x, slope, weight, count, at[~low], depth - 1)

    def _values(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], self._values(tree[2], x), self._values(tree[3], x))

    def _value(self, tree, features: tuple[int, ...]) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, features: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-(self.start + sum(self._value(t, features) for t in self.trees))))

    def sql(self, features: str) -> str:
        """The same score over an array, as SQL."""

        def of(tree) -> str:
            return f"CASE WHEN {features}[{tree[0]}] <= {tree[1]} THEN {of(tree[2])} ELSE {of(tree[3])} END" if isinstance(tree, tuple) else f"{tree!r}D"

        return f"(1 / (1 + exp(-({' + '.join([f'{self.start!r}D', *map(of, self.trees)])}))))"


def thresholds(trees: Trees, rows: Iterable[tuple[tuple[int, ...], float, float]]) -> dict[int, float]:
    """For each kind the lowest score, LEAST_SCORE at least, from which on PRECISION of the calibration candidates are
    confirmed: half way between the last level where they are and the next one where they are not."""
    levels: dict[int, dict[float, list[float]]] = {}
    for features, pos, neg in rows:
        level = levels.setdefault(features[0], {}).setdefault(trees.score(features), [0.0, 0.0])
        level[0] += pos
        level[1] += neg
    out = {}
    for kind, by in levels.items():
        pos = neg = 0.0
        scores = [s for s in sorted(by, reverse=True) if s >= LEAST_SCORE]
        for score, below in zip(scores, [*scores[1:], None]):
            pos, neg = pos + by[score][0], neg + by[score][1]
            if pos and pos >= PRECISION * (pos + neg):
                out[kind] = LEAST_SCORE if below is None else (score + below) / 2
    return out


def masked(rows: Iterable[tuple[tuple[int, ...], float, float]]) -> list[tuple[tuple[int, ...], float, float]]:
    """The rows, and announced examples once more without what announced them."""
    hint, out = list(FEATURES).index("hint"), {}
    for features, pos, neg in rows:
        for f, p, n in ((features, pos, neg), ((*features[:hint], 0, *features[hint + 1 :]), pos * features[hint], 0.0)):
            old = out.get(f, (0.0, 0.0))
            out[f] = old[0] + p, old[1] + n
    return sorted((f, p, n) for f, (p, n) in out.items() if p + n)


def found(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with base_spans and spans: arrays of (kind, s, e) in the order of kind and start.
    A scratch table holds these columns and the candidates between the two reads."""
    kept = [f"`{c}`" for c in besides(docs.columns if keep is None else keep, ("candidates", "fold", "base_spans", "spans"))]
    fold = F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(5)) == 0
    rows = with_candidates(docs, text_col).withColumn("fold", F.coalesce(fold, F.lit(False))).select(*kept, "candidates", "fold")
    holding = F.filter("candidates", lambda c: c["base"])
    rows = materialise(rows.withColumn("base_spans", F.transform(holding, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))))
    one = rows.where(F.size("candidates") > 0).select(F.col("fold").alias("check"), F.explode("candidates").alias("c"))
    counts = one.where(F.col("c")["base"] | ~F.col("c")["near"]).select("check", F.col("c")["f"].alias("f"), F.col("c")["sure"].alias("yes"))
    got = counts.groupBy("check", "f").agg(F.sum(F.col("yes").cast("double")).alias("p"), F.sum((~F.col("yes")).cast("double")).alias("n")).collect()  # combinations of small ranges
    learn = sorted((tuple(r["f"]), r["p"], r["n"]) for r in got if not r["check"])
    check = sorted((tuple(r["f"]), r["p"], r["n"]) for r in got if r["check"])
    known = {f[0] for f, p, _ in check if p}
    if sum(r[1] for r in learn) and sum(r[2] for r in learn):
        trees = Trees().fit(masked(learn))
        least = thresholds(trees, check + [r for r in learn if r[0][0] not in known])
    else:
        trees, least = None, {}
    spans = F.col("base_spans")
    if least:
        bounds = " ".join(f"WHEN {kind} THEN {score!r}D" for kind, score in sorted(least.items()))
        free = F.expr(f"filter(candidates, c -> NOT c.base AND NOT c.near AND {trees.sql('c.f')} >= CASE c.kind {bounds} ELSE 2D END)")
        ranked = F.array_sort(F.transform(free, lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("less"), c["kind"].alias("kind"), c["e"].alias("e"))))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:int,s:int,e:int>>").alias("out"))
        swept = F.aggregate(ranked, start, lambda a, c: F.when(c["s"] >= a["at"], F.struct(c["e"].alias("at"), F.array_append(a["out"], F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))).alias("out"))).otherwise(a), lambda a: a["out"])
        spans = F.concat("base_spans", F.when(F.size("candidates") > 0, swept).otherwise(F.array().cast("array<struct<kind:int,s:int,e:int>>")))
    return rows.withColumn("spans", F.array_sort(spans)).withColumn("base_spans", F.array_sort("base_spans")).select(*kept, "base_spans", "spans")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans go as one, named by the first."""
    plain, text = plain_names(docs, text_col)
    rows = found(plain, text)
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    by_start = F.array_sort(F.transform("spans", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))

    def step(a: Column, c: Column) -> Column:
        gap = F.substring(F.col(text), a["at"] + 1, F.greatest(c["s"] - a["at"], F.lit(0)))
        name = F.when(c["s"] >= a["at"], F.concat(gap, names[c["kind"]])).otherwise("")
        return F.struct(F.greatest(a["at"], c["e"]).alias("at"), F.array_append(a["out"], name).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    parts = F.aggregate(by_start, start, step, lambda a: F.array_append(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(F.col(text)))))
    rows = rows.withColumn(text, F.when(F.size("spans") > 0, F.array_join(parts, "")).otherwise(F.col(text)))
    return own_names(rows, docs)


def _reported(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat(names[c["kind"]], F.lit(":"), c["s"].cast("string"), F.lit(":"), c["e"].cast("string"))), ",")


def op4_pii(docs: DataFrame) -> DataFrame:
    """The result of query op4 over documents."""
    out = found(docs.select("doc_id", "text"), keep=["doc_id"])

    def of_kind(kind: int) -> Callable[[Column], Column]:
        return lambda c: c["kind"] == kind

    counts = [F.size(F.filter("base_spans", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    added = F.size("spans") - F.size("base_spans")
    return out.select("doc_id", *counts, F.sha2(_reported("base_spans"), 256).alias("base_sha256"), _reported("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"), added.cast("long").alias("n_added"))
