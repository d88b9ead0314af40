import random

from tramline.llm.leakage import leak_report, leaked_items, words

DOCS = "doc_id bigint, text string, item_id int, suite string, words string"
ITEMS = "item_id bigint, text string, suite string, doc_id int"


def longest_run(a, b):
    best, last = 0, {}
    for w in b:
        now = {i: last.get(i - 1, 0) + 1 for i, x in enumerate(a) if x == w}
        best, last = max([best, *now.values()]), now
    return best


def in_order(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)] + ["été", "l’arrêt", "Île"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {i: text(rng.randrange(40, 90)) for i in range(25)}
    items[25] = text(9)
    docs, kinds = {}, {}
    for d in range(240):
        body, it, kind = text(rng.randrange(0, 400)), rng.randrange(26), rng.choice(["none", "run12", "run11", "whole", "changed", "spread"])
        w = items[it]
        at = rng.randrange(max(1, len(w) - 11))
        if kind == "changed":
            part = [rng.choice(vocab) if rng.random() < 0.15 else x for x in w]
        elif kind == "spread":
            part = [y for x in w for y in (x, rng.choice(vocab), rng.choice(vocab), rng.choice(vocab))]
        else:
            part = {"none": [], "run12": w[at : at + 12], "run11": w[at : at + 11], "whole": w}[kind]
        p = rng.randrange(len(body) + 1)
        docs[d] = body[:p] + [x.upper() if rng.random() < 0.1 else x for x in part] + body[p:]
        kinds[d] = (it, kind)
    clean = lambda ws: words(" ".join(ws))
    want, near = set(), set()
    for d, body in docs.items():
        b = clean(body)
        for i, w in items.items():
            w = clean(w)
            run = longest_run(w, b)
            if run >= min(12, len(w)):
                want.add((d, i))
            elif run >= 3 and in_order(w, b) >= 0.6 * len(w):
                near.add((d, i))
    for d, (i, kind) in kinds.items():
        if kind == "changed" and in_order(clean(items[i]), clean(docs[d])) >= 0.78 * len(clean(items[i])):
            want.add((d, i))
    df = spark.createDataFrame([(d, ", <b>".join(b), 0, "", "") for d, b in docs.items()] + [(None, "x", 0, "", ""), (900, None, 0, "", ""), (901, "", 0, "", "")], DOCS)
    idf = spark.createDataFrame([(i, " ".join(w), "s", 0) for i, w in items.items()] + [(90, None, "s", 0), (91, "--", "s", 0), (None, "x", "s", 0)], ITEMS)
    for rows in (4_000_000, 10):  # the index in every task, or met in a join
        got = {(r.doc_id, r.item_id) for r in leaked_items(df, idf, index_rows=rows).collect()}
        assert want <= got and got - want <= near
        assert not any(kinds[d][1] == "spread" and kinds[d][0] == i for d, i in got - want)
    report = leak_report(leaked_items(df, idf), df, idf.where("item_id is not null")).collect()
    assert report[0].leaked == len({i for _, i in got}) and report[0].documents == len({d for d, _ in got})


def test_markup_case_accents_and_copies(spark):
    item = "Le tramway de l'été s’arrête à Québec devant une grande halle peinte en vert pâle"
    doc = "x <p>LE TRAMWAY de l’ete&nbsp;s'arrête\n\nà “Québec”, devant <b>une</b> grande halle peinte: en vert"
    df = spark.createDataFrame([(1, doc, 0, "", ""), (2, doc, 0, "", ""), (2, doc, 0, "", ""), (3, "y " * 300_000 + doc, 0, "", "")], DOCS)
    got = sorted((r.doc_id, r.item_id) for r in leaked_items(df, spark.createDataFrame([(5, item, "s", 0), (5, item, "s", 0)], ITEMS)).collect())
    assert got == [(1, 5), (2, 5), (3, 5)]
    assert leaked_items(df.where("false"), spark.createDataFrame([(5, item, "s", 0)], ITEMS)).collect() == []
    assert leaked_items(df, spark.createDataFrame([], ITEMS)).collect() == []


def exact(docs, items, run=12, share=0.75):
    out = set()
    for d, b in docs.items():
        for i, w in items.items():
            if longest_run(w, b) >= min(run, len(w)) or len(w) < 400 and in_order(w, b) >= share * len(w) and len(b) < 2 * len(w):
                out.add((d, i))
    return out


def test_size_partitions(spark):
    """Short, middling and long items: runs at their edges, and as many single changes as may be, by themselves."""
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(3000)]
    items = {i: [rng.choice(vocab) for _ in range(n)] for i, n in enumerate([14, 20, 30, 60, 130, 300, 700, 2000] * 3)}
    docs = {}
    for i, w in items.items():
        docs[len(docs)] = [rng.choice(vocab) for _ in range(9)] + w[:12] + [rng.choice(vocab) for _ in range(9)]
        docs[len(docs)] = w[-12:] + ["z"]
        docs[len(docs)] = w[:11] + ["z", *w[12:23], "z"]
        if len(w) < 400:
            for step in (4, 5):
                docs[len(docs)] = [x if k % step != step - 1 else "changed" for k, x in enumerate(w)]
    df = spark.createDataFrame([(d, " ".join(b), 0, "", "") for d, b in docs.items()], DOCS)
    idf = spark.createDataFrame([(i, " ".join(w), "s", 0) for i, w in items.items()], ITEMS)
    want = exact(docs, items)
    got = {(r.doc_id, r.item_id) for r in leaked_items(df, idf).collect()}
    assert got <= want and len(want - got) <= 0.001 * len(want) and len(want) > 80


def test_markup_of_any_length(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    doc = text.replace("six", f'<a href="{"x" * 5000}">six</a>')
    got = leaked_items(spark.createDataFrame([(1, doc, 0, "", "")], DOCS), spark.createDataFrame([(5, text, "s", 0)], ITEMS)).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 5)]
