"""Candidates for the ratio lose nothing; groups of spellings equal those made one by one."""

import random
from difflib import SequenceMatcher

import pytest

from brinewood.operators import lexicon


def words(seed, n):
    r = random.Random(seed)
    stems = ["".join(r.choices("aeioubcdrstlmnzx", k=r.randint(2, 11))) for _ in range(n // 5)]
    out = {"a", "ab", "aa", "ba", "éé", "silva", "sylva", "silvva"}
    for s in stems:
        for _ in range(5):
            w = list(s)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(["", "a", "z", "tt", "é"])
            out.add("".join(w))
    return sorted(out - {""})


@pytest.mark.parametrize("floor,band", [(0.62, 3), (0.75, None), (0.9, None)])
def test_no_near_pair_is_lost(spark, floor, band):
    a, b = words(1, 250), words(1, 250)[::2] + words(2, 100)
    got = {tuple(r) for r in lexicon.near_pairs(spark.createDataFrame([(x,) for x in [*a, a[0], None, ""]], "observed string"), spark.createDataFrame([(x,) for x in [*b, None]], "name string"), floor, band).collect()}
    near = {(x, y) for x in a for y in b if (band is None or abs(len(x) - len(y)) <= band) and SequenceMatcher(None, x, y).ratio() >= floor}
    assert near <= got and len(got) * 3 < len(a) * len(set(b))


def one_by_one(seen, floor):
    heads, members = [], []
    for x in sorted(seen, key=lambda x: (-len(x), x)):
        at = next((i for i, h in enumerate(heads) if SequenceMatcher(None, x, h).ratio() >= floor), None)
        if at is None:
            heads.append(x)
            members.append([])
            at = -1
        members[at].append(x)
    return {x: (max(m, key=lambda y: seen[y]), sum(seen[y] for y in m)) for m in members for x in m}


@pytest.mark.parametrize("floor", [0.6, 0.75])
def test_groups_equal_those_made_one_by_one(spark, floor):
    r = random.Random(7)
    seen = {w: r.randint(1, 4) for w in words(3, 160)}
    rows = [(w, n) for w, n in seen.items()] + [(None, 5)]
    got = {r.name: (r.label, r["size"]) for r in lexicon.cluster(spark.createDataFrame(rows, "name string, seen long"), floor=floor).collect()}
    assert got == one_by_one(seen, floor)


def test_groups_of_nothing(spark):
    assert lexicon.cluster(spark.createDataFrame([], "name string, seen long")).count() == 0


def test_dictionary_from_rows(spark):
    rows = [("Silva Maria", 0.97, False), ("Silva", 0.5, False), ("silva Jose", None, True), ("Lavrador Lavradur Ana-Rosa d'Avila x9 Jo", 0.96, None), ("Nomes e Cognomes", 0.99, False), (None, 0.99, False), ("Classe", 0.99, False)]
    got = lexicon.build_from_rows(spark.createDataFrame(rows, "name_raw string, score double, by_hand boolean"), ("lavrador",), ("NOMES E COGNOMES",), ("classe",))
    assert {r.name: r.seen for r in got.collect()} == {"SILVA": 2, "MARIA": 1, "JOSE": 1, "ANA-ROSA": 1, "D'AVILA": 1}


def test_groups_by_form(spark):
    rows = [("Itapuca", 2), ("ITAPUÇA", 1), ("itapuco", 1), ("Formosa", 1), ("--", 1), ("..", 1)]
    got = lexicon.cluster(spark.createDataFrame(rows, "name string, seen long"), form=lambda c: lexicon.fold(c, "lower", letters_only=True)).collect()
    assert {(r.name, r.label, r["size"]) for r in got} == {("Itapuca", "Itapuca", 4), ("ITAPUÇA", "Itapuca", 4), ("itapuco", "Itapuca", 4), ("Formosa", "Formosa", 1), ("--", "--", 1), ("..", "..", 1)}
