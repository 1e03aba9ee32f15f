import hashlib
import re

from atlasq.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 13)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, of = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    of |= found
        out.append((doc, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases(spark):
    base = " ".join(f"Word{i}" for i in range(40))
    items = [(1, base), (2, "only three words"), (3, None), (4, "..."), (2, " ".join(f"word{i}" for i in range(20, 36))), (None, "solo"), (12, base)]
    docs = [(1, f"before {base} after"), (2, "see only; THREE - words here"), (3, " ".join(f"word{i}" for i in range(12))), (4, "filler " * 400 + " ".join(f"word{i}" for i in range(5, 18))), (5, None), (6, "a solo b"), (6, "a solo b"), (7, "é only\nthree.words 😀"), (8, "only three")]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), docs, items


def test_op10_against_brute_force(spark):
    docs, items, d, i = cases(spark)
    assert sorted((tuple(r) for r in decontaminate.op10_decontamination(docs, items).collect()), key=str) == brute(d, i)
    assert all(not r["contaminated"] for r in decontaminate.op10_decontamination(docs, items.where("false")).collect())
    assert decontaminate.op10_decontamination(docs.where("false"), items).count() == 0


def test_blocks_give_the_same(spark):
    docs, items, *_ = cases(spark)
    one, many = decontaminate.find(docs, items), decontaminate.find(docs, items, block_chars=60)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_spans_and_documents_go(spark, odd):
    docs, items, d, i = cases(spark)
    clean = decontaminate.without_spans(docs, items)
    assert {r["text"] for r in clean.where("doc_id = 7").collect()} == {"é  😀"}
    assert decontaminate.verdict(decontaminate.find(clean, items)).where("n_hit > 0").count() == 0
    left = decontaminate.without_documents(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(x[0] for x in brute(d, i) if not x[-1])
    assert decontaminate.without_documents(odd, items).columns == odd.columns
    assert decontaminate.find(odd, items).count() == odd.count()
