import random

from tramline.llm.subjects import composition, document_subjects

DOCS = "doc_id bigint, text string, subject string, part double"
WORDS = {"law": ("court clause appeal statute lease verdict judge counsel".split(), "tribunal clause appel bail plainte arbitre avocate loi".split()), "sport": ("match league crowd goal coach final derby pitch".split(), "match ligue tribune but entraîneuse finale gardien tour".split())}
COMMON = ("line stop platform bus bay timetable shelter route".split(), "ligne arrêt quai car horaire abri voie départ".split())


def sentence(rng, lang, subject):
    glue = ["the of in on", "le de la sur"][lang].split()
    pool = WORDS[subject][lang] if subject else COMMON[lang]
    return " ".join(w for _ in range(4) for w in (rng.choice(glue), rng.choice(pool))).capitalize() + rng.choice([". ", ".\n", "? "])


def corpus(rng, n):
    rows, truth = [], {}
    for d in range(n):
        lang, size = int(rng.random() < 0.3), rng.randrange(8, 20)
        subs = rng.choice([[], ["law"], ["sport"], ["law", "sport"]])
        plan = [s for s in subs for _ in range(max(3, size // 3))] + ([rng.choice(["law", "sport"])] if rng.random() < 0.3 else [])
        plan += [None] * max(4, size - len(plan))
        rng.shuffle(plan)
        rows.append((d, "".join(f"{i}.1 " * (rng.random() < 0.1) + sentence(rng, lang, s) for i, s in enumerate(plan)), "", 0.0))
        truth[d] = {s for s in ("law", "sport") if plan.count(s) >= 0.2 * len(plan)}
    return rows, truth


def test_held_out_documents(spark):
    rng = random.Random(8)
    rows, truth = corpus(rng, 900)
    labels = [(d, s if rng.random() < 0.95 else "law") for d, ss in truth.items() if d % 3 == 0 for s in ss]
    docs = spark.createDataFrame(rows, DOCS)
    found = document_subjects(docs, spark.createDataFrame(labels + labels[:9], "doc_id bigint, subject string"), spark.createDataFrame([("law",), ("sport",), ("idle",)], "subject string"))
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
        assert r.part >= 0.2 - 1e-6
    held = [d for d in truth if d % 3]
    assert sum(got.get(d, set()) == truth[d] for d in held) >= 0.95 * len(held)
    assert {r.subject for r in composition(found, docs).collect()} == {"law", "sport"}


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "", 0.0), (2, "", "", 0.0), (None, "court.", "", 0.0), (3, "12 34.\n\n", "", 0.0), (4, "court clause " * 60_000, "", 0.0)], DOCS)
    labels = spark.createDataFrame([(4, "law"), (4, None), (9, "law"), (4, "other")], "doc_id bigint, subject string")
    subjects = spark.createDataFrame([("law",), (None,)], "subject string")
    assert {r.doc_id for r in document_subjects(docs, labels, subjects).collect()} <= {4}
    for d, l, s in ((docs.where("false"), labels, subjects), (docs, labels.where("false"), subjects), (docs, labels, subjects.where("false"))):
        assert document_subjects(d, l, s).collect() == []


def test_partitions_without_any_subject(spark):
    rng = random.Random(5)
    rows, truth = corpus(rng, 200)
    plain = [(1000 + i, "".join(sentence(rng, 0, None) for _ in range(9)), "", 0.0) for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1).unionByName(spark.createDataFrame(plain, DOCS).repartition(2, "doc_id"))
    labels = spark.createDataFrame([(d, s) for d, ss in truth.items() for s in ss], "doc_id bigint, subject string")
    found = {r.doc_id for r in document_subjects(docs, labels, spark.createDataFrame([("law",), ("sport",)], "subject string")).collect()}
    assert found and max(found) < 1000


def test_languages_are_a_parameter(spark):
    rng = random.Random(3)
    words = {"law": ["gericht", "klausel", "richter"], "sport": ["spiel", "tor", "liga"]}
    rows, truth = [], {}
    for d in range(300):
        sub = rng.choice(["law", "sport"])
        rows.append((d, ". ".join(" ".join(w for _ in range(4) for w in (rng.choice(["der", "die", "und"]), rng.choice(words[sub]))) for _ in range(9)), "", 0.0))
        truth[d] = sub
    labels = spark.createDataFrame([(d, s) for d, s in truth.items() if d % 2], "doc_id bigint, subject string")
    found = document_subjects(spark.createDataFrame(rows, DOCS), labels, spark.createDataFrame([("law",), ("sport",)], "subject string"), languages={"de": "der die und das in zu"})
    got = {r.doc_id: r.subject for r in found.collect()}
    assert sum(got.get(d) == s for d, s in truth.items()) >= 290


def test_weights_solve_for_fixed_components():
    import numpy as np

    from tramline.llm.subjects import sentence_weights

    h = np.array([[0.9, 0.05], [0.05, 0.9], [0.05, 0.05]], dtype=np.float32)
    w = sentence_weights(np.array([0, 0, 0, 1, 1, 0, 2]), np.array([0, 3]), h, np.array([0.5, 0.5]), 30)
    assert w[0, 0] > 0.99 and abs(w[1, 1] - 0.66) < 0.1 and np.allclose(w.sum(axis=1), 1)
