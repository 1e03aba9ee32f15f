import collections
import hashlib
import random
import re

from atlasq.llm import pii
from tests.conftest import DATA


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return out


PIECES = ["1", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "1 ", "-2", "12", "255", "256", "4111111111111111", "4111 1111 1111 1111", ".", " ", "-", "+", "@", "a", "b.c", "x@y.z", "a@b-c.d.e", "(", "é", "😀", "\n", "+1 (543) 555-9258", "10.0.0.1", "_", "%", "", "  ", "--"]


def test_base_spans_against_brute_force(spark, plain):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    rows += [(10_000 + i, t) for i, t in enumerate(["1" * 4000, "1 " * 5000, "a." * 10_000 + "@b." + "c." * 5000 + "d", "1." * 500, "+" * 1000 + "+1" + "(" * 50_000])]
    rows += [(20_000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [(30_000 + i, r["text"]) for i, r in enumerate(plain.collect())]
    texts = dict(rows)
    for r in pii.op4_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        want = brute(texts[r["doc_id"]])
        n = collections.Counter(k for k, *_ in want)
        shown = [f"{k}:{a}:{b}" for k, a, b in want]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (n["email"], n["ip"], n["card"], n["phone"]), texts[r["doc_id"]][:200]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(shown) <= set(spans)
        order = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in spans)]
        assert order == sorted(order)


def test_trees_find_what_a_greedy_pattern_joined(spark):
    rng = random.Random(1)

    def card():
        while True:
            n = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if luhn(n):
                return n

    rows = [(i, f"{('pay with', 'then')[i % 2]} {card()} or {('call', 'so')[i // 2 % 2]} +1 (555) 555-{rng.randint(1000, 9999)} as order {rng.randint(10**15, 10**16 - 1)} x") for i in range(200)]
    joined = f"two of them {card()} {card()} and +1 (555) 555-1234 10.1.2.3 here"
    found = {r["doc_id"]: r for r in pii.op4_pii(spark.createDataFrame([*rows, (999, joined)], "doc_id bigint, text string")).collect()}
    spans = [s.split(":") for s in found[999]["spans"].split(",")]
    assert [k for k, *_ in spans] == ["ip", "card", "card", "phone"]
    assert sum(len(r["spans"].split(",")) for k, r in found.items() if k < 999) <= 2 * 200 + 45  # a tenth of random order numbers pass as cards


def test_column_scores_like_the_trees(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(tuple(rng.randrange(b) for b in pii.FEATURES.values()), float(rng.randrange(4)), float(rng.randrange(4))) for _ in range(60)]
    trees = pii.Trees().fit(rows)
    df = spark.createDataFrame([(list(f),) for f, _, _ in rows], "f array<int>").select("f", F.expr(trees.sql("f")).alias("s"))
    assert all(abs(trees.score(tuple(r["f"])) - r["s"]) < 1e-12 for r in df.collect())


def test_redaction_odd_and_empty_tables(spark, odd):
    docs = spark.createDataFrame([(1, "é a@b.cd and 10.0.0.1!"), (2, None), (3, "clean")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()} == {1: "é <EMAIL> and <IP>!", 2: None, 3: "clean"}
    out = pii.redacted(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert pii.op4_pii(odd.where("false")).count() == 0 and pii.found(odd).count() == odd.count()


def test_card_with_a_separator_behind_every_digit(spark):
    texts = [sep.join("4111111111111111") for sep in " -"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.op4_pii(docs).collect():
        assert (r["n_card"], r["spans"]) == (1, "card:0:31") and r["base_sha256"] == hashlib.sha256(b"card:0:31").hexdigest()
    assert [r["text"] for r in pii.redacted(docs).collect()] == ["<CARD>", "<CARD>"]


def generated(rng, n, first):
    """Texts with numbers and names of which each is personal or not: (id, text, personal spans, other spans)."""
    out = []
    for i in range(first, first + n):
        text, yes, no = "", [], []

        def put(piece, personal=None):
            nonlocal text
            if personal is not None:
                (yes if personal else no).append((len(text), len(text) + len(piece)))
            text += piece

        local = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        put("Some words. ")
        match i % 6:
            case 0:
                put(rng.choice(["phone ", "call ", "mobile: "]))
                put(local, True)
            case 1:
                put("item ")
                put(f"{rng.randint(10, 99)}.{rng.randint(100, 999)}.{rng.randint(1000, 9999)}", False)
            case 2:
                put(rng.choice(["token = ", 'api_key: "', "password="]))
                put(secret, True)
            case 3:
                put("name" + str(i) + rng.choice([" [at] host [dot] org", " (at) mail.example.com", "[at]web(dot)net"]), True)
            case 4:
                put("password: ")
                put("required", False)
            case 5:
                put("the secret is ")
                put("between", False)
        put(" and more words")
        out.append((i, text, yes, no))
    return out


def test_added_spans_by_precision_and_recall_on_other_texts(spark):
    rng = random.Random(11)
    texts = generated(rng, 1200, 0)
    texts += [(5000 + i, f"so here is {rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)} once", [], []) for i in range(5)]  # look like announced ones
    found = {r["doc_id"]: {tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s} for r in pii.op4_pii(spark.createDataFrame([(i, t) for i, t, *_ in texts], "doc_id bigint, text string")).collect()}
    yes, no = (sum(s in found[i] for i, _, *k in texts for s in k[which]) for which in (0, 1))
    assert yes >= 0.95 * sum(len(y) for _, _, y, _ in texts) and no <= 0.02 * yes
    assert sum(bool(found[i]) for i in range(5000, 5005)) >= 4


def test_kinds_without_examples_in_the_calibrating_fifth(spark):
    docs = spark.createDataFrame([(1, "token = 04dbebab91ab85687d33eeaaf9ac699e"), (2, "phone 555-123-4000"), (3, "room 12 345 6789 99")], "doc_id bigint, text string")
    assert all(r["n_added"] >= 0 for r in pii.op4_pii(docs).collect())
