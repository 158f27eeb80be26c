"""Attribution of atoms to records against scores of all pairs."""

import random
import re

import pytest

from folioscope.operators import rollups as R

ATOMS = "atom long, title string, what string, sources array<string>, refs array<long>"


def words(t):
    return {w for w in re.split(r"[^a-zа-яё0-9]+", t.lower()) if len(w) >= 4}


def brute(atoms, records):
    """(atom, ref, score) of all pairs with a score."""
    out = []
    for a in atoms:
        needles = [(w, 1) for w in words("\n".join([a[1] or "", a[2] or "", "\n".join(a[3])]))]
        for s in a[3]:
            low = s.lower()
            bare = re.sub(r"^www\.", "", re.sub(r"^https?://", "", low))
            m = re.match(r"https?://([^/?#:]+)(?::\d+)?([^?#]*)", low)
            bits = "/".join([p for p in m[2].split("/") if p][:2]) if m else ""
            needles += [(bare, 8), (bits, 6), (re.sub(r"^www\.", "", m[1]) if m else "", 3)]
        for ref, text, *_ in records:
            score = sum(n for w, n in needles if w and w in (text or "").lower())
            if score:
                out.append((a[0], ref, score))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(12)
    vocab = [a + b for a in ("river", "stone", "light", "garden", "letter") for b in ("", "s", "less", "fully", "1")]
    records = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 25)))) for i in range(150)]
    records += [(200, "see https://www.Example.org/acme/tool/x for riverstone"), (201, "example.org and acme/tool"), (202, None), (203, "")]
    records += [(300 + i, records[3][1]) for i in range(30)]
    atoms = [(i, rng.choice(vocab), " ".join(rng.choices(vocab, k=4)), [], []) for i in range(20)]
    atoms += [(50, "Tool", "a tool", ["https://www.example.org/acme/tool/y", "https://example.org"], []), (51, "x", None, ["not an address"], []),
              (52, "own", "river", [], [7, 7, -1]), (53, "foreign", "garden", [], [-5]), (54, None, "", [""], [])]
    return atoms, records


@pytest.mark.parametrize("block", [8, 1024])
def test_atom_sources(spark, tables, block):
    atoms, records = tables
    got = sorted(tuple(r) for r in R.atom_sources(spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(records, "ref long, text string"), block).collect()
                 if r.score is not None)
    want, pairs = [], brute([a for a in atoms if a[0] != 52], records)
    for a in atoms:
        best = max((s for i, _, s in pairs if i == a[0]), default=None)
        want += [p for p in pairs if p[0] == a[0] and p[2] == best]
    assert got == sorted(want)


def test_own_references_come_first(spark, tables):
    atoms, records = (spark.createDataFrame(t, s) for t, s in zip(tables, (ATOMS, "ref long, text string")))
    assert [tuple(r) for r in R.atom_sources(atoms.filter("atom = 52"), records).collect()] == [(52, 7, None)]
    assert all(r.score is not None for r in R.atom_sources(atoms.filter("atom = 53"), records).collect())


def test_candidates_and_parts(spark, tables):
    atoms, records = tables
    a, r = spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(records, "ref long, text string")
    pairs = brute(atoms, records)
    want = [p for i in {p[0] for p in pairs} for p in sorted((p for p in pairs if p[0] == i), key=lambda p: (-p[2], p[1]))[:4]]
    assert sorted(tuple(x)[:3] for x in R.record_candidates(a, r, 4, block=16).collect()) == sorted(want)
    parted = R.record_candidates(a.selectExpr("*", "atom % 3 AS part"), r.selectExpr("*", "ref % 3 AS part"), 2, block=16)
    mine = [p for p in pairs if p[0] % 3 == p[1] % 3]
    want = [p for i in {p[0] for p in mine} for p in sorted((p for p in mine if p[0] == i), key=lambda p: (-p[2], p[1]))[:2]]
    assert sorted(tuple(x)[:3] for x in parted.collect()) == sorted(want)


def test_blocks_that_cannot_win_are_not_scored(spark):
    """Each atom repeats one record; a block of other records shares two of its words at most."""
    rng = random.Random(1)
    texts = [" ".join(f"word{rng.randrange(2000)}" for _ in range(30)) for _ in range(400)]
    records = spark.createDataFrame(list(enumerate(texts)), "ref long, text string")
    atoms = spark.createDataFrame([(i, "", texts[i * 7], [], []) for i in range(50)], ATOMS)
    search = R._record_search(atoms, records, 1, True, 4)
    opened, all_blocks = search.first.count() + search.rest().count(), 50 * 100
    scored = opened * 4
    print("pairs scored", scored, "of", 50 * 400, "blocks with any shared word", search.bounds.count())
    assert scored < 0.1 * 50 * 400 and opened < all_blocks
    assert sorted((r.atom, r.ref) for r in R.atom_sources(atoms, records, 4).collect()) == [(i, i * 7) for i in range(50)]
