"""Subjects of documents: a seeded non-negative factorization whose anchored components are the subjects.

The rows that are factored are the documents' sentences, so that a document's mixture says how much of it deals with each
subject.  Each subject has one component, anchored by the labels; further components are free for text without a subject.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.sample import sampled

#: Markup of any length: what opens like a tag up to its end.
TAG = re.compile(r"<[/!?]?[a-zA-Z-][^<>]*>")
#: Words without digits, and what ends a sentence.
TOKEN = re.compile(r"[^\W\d_]+|[.!?…]+(?=[\s\"'»”’)]|$)|\n")
ENDS = ".!?…\n"


#: Words that tell the languages apart; a parameter of document_subjects. Each subject has one component per language.
LANGUAGES = {
    "en": "the of and a in to is for on by at with from that this as was were be has have it not or an are which its",
    "fr": "le la les de des du un une et est dans pour sur à au aux par avec qui que ne pas ce cette d l en s ou sont son sa",
}


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    return TOKEN.findall(TAG.sub(" ", text.lower()) if "<" in text else text.lower())


class Words(dict):
    """Token -> number: sentence ends 1, unknown words 0, known ones from 2."""

    def __missing__(self, w: str) -> int:
        n = 1 if w[0] in ENDS else 0
        if len(self) < 1_000_000:
            self[w] = n
        return n


def _sentences(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids without sentence ends, and where each sentence that has a word begins among them."""
    end = ids == 1
    before = np.cumsum(end)[~end]
    word = ids[~end]
    if not len(word):
        return word, np.empty(0, dtype=np.int64)
    return word, np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))


def _factor(word: np.ndarray, sid: np.ndarray, mask: np.ndarray, terms: int, anchored: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Alternating multiplicative updates for the Kullback-Leibler distance; (component term weights H, components' sizes).

    The sentence weights W are seeded by mask and stay within it, H by the terms' shares under that seed.
    """
    n_s, k = mask.shape
    h = np.array([np.bincount(word, weights=mask[sid, j], minlength=terms) for j in range(k)]) + 0.01
    rng = np.random.default_rng(5)
    h[anchored:] *= rng.uniform(0.7, 1.3, (k - anchored, terms))  # free components begin as the whole, a little apart from one another
    h /= h.sum(axis=1, keepdims=True)
    w = mask / mask.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        part = w[sid] * h.T[word].astype(np.float32)
        part /= part.sum(axis=1, keepdims=True) + 1e-30
        w = np.stack([np.bincount(sid, weights=part[:, j], minlength=n_s) for j in range(k)], axis=1) * mask
        w = (w / (w.sum(axis=1, keepdims=True) + 1e-30)).astype(np.float32)
        h = np.array([np.bincount(word, weights=part[:, j], minlength=terms) for j in range(k)]) + 0.002
        h /= h.sum(axis=1, keepdims=True)
    return h, w.sum(axis=0) + 1.0


def fit_components(rows: list[tuple[str, list[str]]], subjects: list[str], languages: dict[str, str] = LANGUAGES, free: int = 3, rounds: int = 25, least: int = 3, most_terms: int = 50_000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(terms, each component's term weights, the components' shares of all sentences) from labelled texts.

    Components: per language one for each subject, then `free` others, factored apart for each language's sentences.  A
    sentence may hold the subjects of its document and the free components and, with little weight, the other subjects, as
    labels may be wrong.
    """
    seen: Counter = Counter()
    for t, _ in rows:
        seen.update({w for w in tokens(t) if w[0] not in ENDS})
    terms = sorted((w for w, n in seen.items() if n >= least), key=lambda w: (-seen[w], w))[:most_terms]
    known = Words({w: i + 2 for i, w in enumerate(terms)})
    per, v, langs = len(subjects) + free, len(terms) + 2, len(languages)
    speaks = np.zeros((v, langs), dtype=np.float32)
    for j, ws in enumerate(languages.values()):
        speaks[[known[w] for w in ws.split() if known[w] >= 2], j] = 1
    place = {s: i for i, s in enumerate(subjects)}
    parts: list[list] = [[[], [], []] for _ in range(langs)]
    count = [0] * langs
    for t, labels in rows:
        got = tokens(t)
        word, begin = _sentences(np.fromiter(map(known.__getitem__, got), dtype=np.int32, count=len(got)))
        if not len(begin):
            continue
        tongue = np.add.reduceat(speaks[word], begin, axis=0)
        tongue = (tongue + 0.02 * tongue.sum(axis=0)).argmax(axis=1)  # a sentence that doesn't tell is in the document's language
        own = np.full(per, 0.01, dtype=np.float32)
        own[len(subjects) :] = 1
        own[[place[s] for s in labels if s in place]] = 1
        for (x, y), lang in zip(zip(begin, [*begin[1:], len(word)]), tongue.tolist()):
            ws = word[x:y][word[x:y] >= 2]
            if len(ws):
                parts[lang][0].append(ws)
                parts[lang][1].append(np.full(len(ws), count[lang], dtype=np.int32))
                parts[lang][2].append(own)
                count[lang] += 1
    h, size = np.full((per * langs, v), 1 / v), np.ones(per * langs)
    for lang, (ws, sids, masks) in enumerate(parts):
        if ws:
            at = slice(lang * per, (lang + 1) * per)
            h[at], size[at] = _factor(np.concatenate(ws), np.concatenate(sids), np.array(masks), v, len(subjects), rounds)
    h[:, :2] = 1 / v  # unknown words speak for none
    return terms, h, size / size.sum()


def sentence_weights(word: np.ndarray, begin: np.ndarray, h: np.ndarray, size: np.ndarray, rounds: int) -> np.ndarray:
    """W of sentences by components for fixed H: `rounds` multiplicative updates, from the components' sizes on.

    word: the sentences' words one after another, begin: where each begins; h: terms by components.
    """
    length = np.diff(np.append(begin, len(word)))
    each = h[word]
    w = np.repeat(size[None, :].astype(np.float32), len(begin), axis=0)
    for _ in range(rounds):
        part = np.repeat(w, length, axis=0)
        part *= each
        part /= part.sum(axis=1, keepdims=True)
        w = np.add.reduceat(part, begin, axis=0) / length[:, None].astype(np.float32)
    return w


def document_subjects(
    documents: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = 0.2, most_labelled: int = 4000, most_chars: int = 40_000_000, most_terms: int = 50_000, rounds: int = 6, languages: dict[str, str] | None = None
) -> DataFrame:
    """(doc_id, subject, part): subjects that at least `share` of a document's sentences deal with, and their part.

    The components H are fitted on the labelled documents, at most `most_labelled` of them and of `most_chars` characters in
    all, chosen by a hash of doc_id, and on their `most_terms` commonest terms; those bounds are on the fit alone.  Every
    document's sentences then get their weights W by `rounds` multiplicative updates with H fixed, without a shuffle.  A
    sentence deals with the subject that holds most of its weight, over all languages, unless a free component holds more.
    languages: name -> words that tell it.  Labels that name no subject of `subjects` are ignored, as are repeated labels;
    without labels or subjects, and for null or wordless texts, there are no rows.
    """
    spark = documents.sparkSession
    languages = languages or LANGUAGES
    names = sorted({r.subject for r in subjects.select("subject").distinct().collect() if r.subject})
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    chosen = labels.where(F.col("subject").isin(names)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.sort_array(F.collect_set("subject")).alias("subjects")).where("doc_id is not null")
    rows = []
    if names:
        few = {r.doc_id: r.subjects for r in sampled(chosen, ["doc_id"], most_labelled)}
        if few:
            ids = F.broadcast(spark.createDataFrame([(i,) for i in few], "doc_id bigint"))
            rows = [(r.text, few[r.doc_id]) for r in sampled(docs.join(ids, "doc_id"), ["doc_id"], most_labelled, F.length("text"), most_chars)]
    terms, h, sizes = fit_components(sorted(rows), names, languages, most_terms=most_terms) if rows else ([], None, None)
    given = spark.sparkContext.broadcast((terms, None if h is None else np.ascontiguousarray(h.T.astype(np.float32)), sizes))
    per = None if h is None else len(sizes) // len(languages)

    def mix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, weight, sizes = given.value
        known = Words({w: i + 2 for i, w in enumerate(terms)})

        def told(held: list[tuple]) -> Iterator[pd.DataFrame]:
            """Rows of documents (doc_id, words, begins), whose sentences are weighed together; no frame if none has a subject, as an empty one has no text column for Arrow."""
            word = np.concatenate([w for _, w, _ in held])
            n = np.array([len(b) for _, _, b in held])
            offset = np.cumsum([0, *[len(w) for _, w, _ in held[:-1]]])
            begin = np.concatenate([b for _, _, b in held]) + np.repeat(offset, n)
            w = sentence_weights(word, begin, weight, sizes, rounds)
            top = w.reshape(len(w), -1, per).sum(axis=1).argmax(axis=1)
            doc = np.repeat(np.arange(len(held)), n)
            count = np.bincount(doc * per + top, minlength=len(held) * per).reshape(-1, per)[:, : len(names)]
            d, j = np.nonzero((count >= share * n[:, None] - 1e-9) & (count > 0))
            if len(d):
                yield pd.DataFrame({"doc_id": [held[i][0] for i in d], "subject": [names[i] for i in j], "part": count[d, j] / n[d]})

        for b in batches:
            held, size = [], 0
            for doc_id, text in zip(b["doc_id"], b["text"]):
                t = tokens(text)
                word, begin = _sentences(np.fromiter(map(known.__getitem__, t), dtype=np.int64, count=len(t)))
                if len(begin) and weight is not None:
                    held.append((doc_id, word, begin))
                    size += len(word)
                if size > 50_000:
                    yield from told(held)
                    held, size = [], 0
            if held:
                yield from told(held)

    return docs.mapInPandas(mix, "doc_id bigint, subject string, part double")


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, documents, share): how many documents deal with each subject, and their share of all documents."""
    n = documents.agg(F.count("*").alias("all"))
    return found.groupBy("subject").agg(F.count_distinct("doc_id").alias("documents")).crossJoin(F.broadcast(n)).select("subject", "documents", F.round(F.col("documents") / F.col("all"), 6).alias("share"))
