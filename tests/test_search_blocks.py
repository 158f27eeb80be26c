"""The block-max search against scores of every note."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import search as S

WORDS = [f"{a}{b}" for a in ("river", "stone", "light", "garden", "letter", "paper") for b in ("", "s", "ing", "less", "ful")]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    # a word as common as the first is in every note; many notes are copies and tie
    notes = [" ".join(rng.choices(WORDS, k=rng.randint(0, 40), weights=range(len(WORDS), 0, -1))) for _ in range(300)]
    notes = [notes[rng.randrange(100)] if i % 3 == 0 else n for i, n in enumerate(notes)]
    docs = spark.createDataFrame([(f"{WORDS[i % 7]}/note {i:03d}.md", t) for i, t in enumerate(notes)] + [("empty.md", ""), ("null.md", None)],
                                 "path string, text string").repartition(3)
    topics = spark.createDataFrame([(i, " ".join(rng.sample(WORDS, rng.randint(1, 5)))) for i in range(25)] + [(90, "nowhere"), (91, ""), (92, None)],
                                   "topic long, text string")
    return docs, topics


def listed(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block,keep", [(1, 3), (8, 5), (8, 60), (1024, 60)])
def test_best_notes(corpus, block, keep):
    docs, topics = corpus
    want = S.candidates(S.lexical_scores(docs, topics), keep).select("topic", "path", F.col("score").cast("long"), "rank")
    assert listed(S.best_notes(docs, topics, keep, block)) == listed(want)


@pytest.mark.parametrize("block", [4, 1024])
def test_votes(corpus, block):
    docs, topics = corpus
    got = listed(S.vote_ranking(docs, topics, 4, block=block))
    texts = {r.path: (r.text or "").lower() for r in docs.collect()}
    want = []
    for t in topics.collect():
        parts = set((t.text or "").split())
        votes = sorted((-sum(p in x for p in parts), path) for path, x in texts.items() if any(p in x for p in parts))
        want += [(t.topic, path, -n, i + 1) for i, (n, path) in enumerate(votes[:4])]
    assert got == sorted(want)


def test_notes_never_meet_topics_one_by_one(corpus):
    docs, topics = corpus
    for df in (S.best_notes(docs, topics, block=8), S.vote_ranking(docs, topics, block=8)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            assert not ("hashpartitioning" in line and "topic" in line and "path" in line), line


def test_empty(spark, corpus):
    docs, topics = corpus
    none = docs.filter("false")
    assert S.best_notes(none, topics).collect() == [] and S.best_notes(docs, topics.filter("false")).collect() == []
    assert S.vote_ranking(none, topics).collect() == []


def test_lists_hold_numbers_for_names(spark, monkeypatch):
    """Lists of notes move between tasks, so a note's name is not in them; names that repeat or are null stay one note."""
    held, index = [], S.block_index
    monkeypatch.setattr(S, "block_index", lambda *a, **k: held.append(index(*a, **k)) or held[-1])
    docs = spark.createDataFrame([("b", "stone river"), ("b", "garden"), ("a", "stone"), (None, "riverside"), ("c", "stone river")],
                                 "path string, text string")
    topics = spark.createDataFrame([(1, "stone river garden")], "topic long, text string")
    got = [tuple(r) for r in S.vote_ranking(docs, topics, 3).orderBy("pos").collect()]
    assert got == [(1, "b", 3, 1), (1, "c", 2, 2), (1, None, 1, 3)]
    assert dict(held[0].dtypes)["posts"] == "array<struct<path:bigint,points:int>>"


def test_blocks_to_open_are_known_by_size(corpus):
    """Only the lists of opened blocks move: the blocks come from a stored table."""
    docs, topics = corpus
    words = S._topic_words(topics)
    search = S.BlockSearch(S.block_index(docs, S._postings(docs), 8), words, 3)
    for df in (search.bounds, search.first):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_evidence_and_snippets_of_long_texts(spark):
    """Windows of a text of many blocks are those that a plain walk over it finds."""
    rng = random.Random(5)
    texts = ["", "x", "İstanbul — alpha", *[rng.choice([" ", "é — ", "İ, "]).join(rng.choice(["alpha", "Beta", "gamma7", "дом", "z"]) if rng.random() < 0.2 else f"w{rng.randint(0, 999)}"
                                                                                    for _ in range(n)) for n in (50, 1700, 9000)]]
    terms = ["alpha", "beta", "gamma7", "дом", "w7"]
    d = spark.createDataFrame([(i, t, terms) for i, t in enumerate(texts)], "i int, t string, terms array<string>")
    got = {r["i"]: r["e"] for r in d.select("i", S.evidence(F.col("t"), F.col("terms")).alias("e")).collect()}
    for i, t in enumerate(texts):
        line = "".join(c if c.isalnum() else " " for c in t.replace("İ", "I").lower())
        best = sorted((-len(set(line[s:s + 1000].split(" ")) & set(terms)), s) for s in range(0, len(t), 800))[:2]
        want = "\n\n".join(f"[{s + 1}–{min(s + 1000, len(t))}]\n{t[s:s + 1000]}" for s in sorted(s for _, s in best))[:2500]
        assert got[i] == want, i
    rules_of = d.select(S.evidence(F.col("t"), F.col("terms")).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in rules_of and "translate" not in rules_of
