"""Records, exports, ships, dictionaries, measures and layout against plain Python."""

from difflib import SequenceMatcher
from statistics import median

import pytest
from pyspark.sql import functions as F

from brinewood.functions import lexical
from brinewood.operators import catalog, evaluate, layout, lexicon, records, search
from brinewood.plans import record_queries
from brinewood.sources import tables


def fold(s):
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).upper().strip()


def test_ships_equal_comparing_everything(spark):
    import random

    rng = random.Random(2)
    ships = ["CONTE VERDE", "FORMOSA", "Araguaya", "RE VITTORIO", "VERDI", "MAFALDA", "ÇELIK", "ABCD", "ORANIA"]
    terms = [s.split()[0] for s in ships]
    for _ in range(150):
        w = list(rng.choice(ships))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "X", "E"])
        terms.append("".join(w))
    got = {(r.term, r.ship, round(r.ratio, 9)) for r in search.ship_ratios(spark.createDataFrame([(x,) for x in terms], "term string"), spark.createDataFrame([(x,) for x in ships], "ship string")).collect()}
    want = {(a, b, round(SequenceMatcher(None, fold(a), fold(b)).ratio(), 9)) for a in terms for b in ships}
    assert got == {x for x in want if x[2] >= 0.85}


def test_the_first_term_that_names_a_ship_is_split_off(spark):
    ships = spark.createDataFrame([("FORMOSA",), ("VERDI",), ("",), (None,)], "ship string")
    asked = [(1, "Silva formoza verdi"), (2, "formosa"), (3, "ver Silva"), (4, None), (5, "  Jo  Formosa ")]
    got = {r.k: (r.term, r.rest) for r in search.split_ships(spark.createDataFrame(asked, "k int, q string"), ["k"], "q", ships).collect()}
    assert got == {1: ("formoza", "Silva verdi"), 2: (None, "formosa"), 3: (None, "ver Silva"), 4: (None, ""), 5: (None, "Jo Formosa")}


def test_bonus_of_like_ships(spark):
    rows = spark.createDataFrame([(1, "FORMOSA"), (2, "VERDI"), (3, None)], "k int, ship string")
    got = {r.k: r.group_ratio for r in search.ship_bonus(rows, "ship", spark.createDataFrame([("FORMOZA",)], "term string")).collect()}
    assert got[1] == pytest.approx(SequenceMatcher(None, "FORMOZA", "FORMOSA").ratio()) and got[2] is None and got[3] is None


CAPTIONS, PRINTED = ("NOME E SOBRENOME", "IDADE", "NUMERO DE ORDEM"), ("nome", "sobrenome", "idade", "profissao", "ordem")


def heading(text):
    t = fold(" ".join(text.split()))
    grams = lambda s: {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}
    if t in CAPTIONS or any(" " in c and len(grams(t) & grams(c)) >= 0.55 * len(grams(t) | grams(c)) for c in CAPTIONS):
        return True
    words = [w for w in "".join(c if c.isalnum() or c.isspace() else " " for c in t.lower() if not c.isdigit()).split() if len(w) > 3]
    if len(words) == 1:
        return words[0] in PRINTED
    return bool(words) and all(any(SequenceMatcher(None, w, p).ratio() >= 0.8 for p in PRINTED) for w in words)


def test_headings_equal_the_rule(spark):
    texts = ["Nome e sobrenome", "NOME SOBRENOMME", "nome", "nomme", "idade profissao", "idadde, profisao 12", "Silva Jose", "", "12", "Numero ordem", "ordem Silva", "sobrenome", "IDADE", "nome " * 300, "x" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: bool(r.heading) for r in lexical.headings(rows, ["k"], "t", CAPTIONS, PRINTED).collect()}
    assert got == {k: heading(t) for k, t in enumerate(texts)}


def test_searchable_rows(spark, tmp_path):
    import json

    def row(n, raw, page=1, **more):
        words = raw.split()
        names = {"surname": " ".join(words[:-1]) or raw, "given": words[-1] if len(words) > 1 else ""} if words else {}
        return {"n": n, "page": page, "name_raw": raw, **names, **more}

    rows = [row(1, "Nome e sobrenome"), row(2, "SILVA JOSE"), row(3, '" MARIA'), row(4, ""), row(5, "PEDRO"), row(6, "TITLE ROW", header=True), row(7, "AB"), row(8, '" ANNA', page=2)]
    make = lambda **more: {"schema": 18, "engine": "e", "hash": "h1", "file": "f", "rows": rows, "voyage": {"ship": "VERDI", "year": 1924}} | more
    for name, r in (("h1", make()), ("h2", make(hash="h2", schema=19)), ("h3", make(hash="h3", engine=None))):
        (tmp_path / f"{name}.json").write_text(json.dumps(r))
    (tmp_path / "bad.json").write_text("{")
    got = records.searchable(tables.records(spark, str(tmp_path)), CAPTIONS, PRINTED).collect()
    assert {(r.doc, r.row, r.text, r.ditto_source, r.ship, r.year) for r in got} == {
        ("h1", 2, "SILVA JOSE", None, "VERDI", 1924), ("h1", 3, "SILVA MARIA", "mark", "VERDI", 1924), ("h1", 5, "SILVA PEDRO", "position", "VERDI", 1924),
        ("h1", 7, "TITLE AB", "position", "VERDI", 1924), ("h1", 8, '" ANNA', None, "VERDI", 1924),
    }


def test_records_are_put_whole_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "records")
    put = lambda *rows: tables.upsert_records(spark.createDataFrame(rows, "hash string, value int, saved_at string"), path)
    assert tables.stored_records(spark, path) is None
    put(("aa1", 1, "1"), ("aa2", 2, "1"), ("bb1", 3, "1"))
    put(("aa1", 10, "2"), ("aa1", 9, "1"), ("cc1", 4, "1"))
    assert {(r["hash"], r.value) for r in tables.stored_records(spark, path).collect()} == {("aa1", 10), ("aa2", 2), ("bb1", 3), ("cc1", 4)}
    assert [r.value for r in tables.stored_records(spark, path, ["aa2"]).collect()] == [2]


def test_dictionaries_are_loaded_scored_and_rank_readings(spark, tmp_path):
    (tmp_path / "names.json").write_text('{"SILVA": 40, "SALVA": 2, "COSTA": 7}')
    names = lexicon.load(spark, str(tmp_path / "names.json"))
    assert names.count() == 3 and lexicon.load(spark, str(tmp_path / "none.json")).count() == 0
    got = lexicon.ranked(spark.createDataFrame([(1, ["xyzw", "Sylva", "COSTA", ""]), (2, [])], "k int, r array<string>"), ["k"], "r", names).collect()
    ranked = {r.k: [(x.word, x.score) for x in r.ranked] for r in got}
    assert ranked == {1: [("COSTA", 1.0), ("Sylva", 0.8), ("xyzw", 0.0)], 2: []}


def bands(ordinals, written, height):
    """The rule, mark by mark."""
    centre = lambda m: (m[0] + m[1]) / 2

    def pitch(at):
        gaps = [b - a for a, b in zip(sorted(at), sorted(at)[1:]) if b - a > 1]  # noqa: B905
        if not gaps:
            return None
        m = median(gaps)
        return median([g for g in gaps if 0.6 * m <= g <= 1.4 * m] or [m])

    o, w = sorted(map(centre, ordinals)), sorted(map(centre, written))
    use = o if len(o) >= max(8, 0.5 * len(w)) else w
    p = pitch(use) or pitch(o) or pitch(w)
    if not p:
        return []
    use = use or o
    base = use[0]
    base += median([(c - base) - round((c - base) / p) * p for c in use])
    out = []
    for i in range(round((min(o + w) - base) / p), round((max(o + w) - base) / p) + 1):
        top, bottom = base + i * p - p / 2, base + i * p + p / 2
        held = [m for m in written if top <= centre(m) <= bottom]
        out.append((max(0.0, min([top] + [m[0] - 1 for m in held])), min(height, max([bottom] + [m[1] + 1 for m in held]))))
    return out


def test_row_bands_equal_the_rule(spark):
    import random

    rng, rows, want = random.Random(5), [], {}
    for k in range(12):
        spot = lambda i: 50 + i * 21.0 + rng.uniform(-1.5, 1.5)
        ordinals = [(y := spot(i), y + 8.0) for i in range(20) if k % 3 and rng.random() < 0.8]
        written = [(y := spot(i) - 4, y + rng.uniform(12, 24)) for i in range(20) if rng.random() < 0.6] if k != 4 else []
        rows += [(k, "ordinal", a, b, 500.0) for a, b in ordinals] + [(k, "written", a, b, 500.0) for a, b in written]
        want[k] = bands(ordinals, written, 500.0)
    got = {}
    for r in layout.row_bands(spark.createDataFrame(rows, "k int, kind string, y0 double, y1 double, height double"), ["k"]).orderBy("k", "n").collect():
        got.setdefault(r.k, []).append((r.top, r.bottom))
    assert set(got) == set(want)
    for k, b in want.items():
        assert [x for pair in got[k] for x in pair] == pytest.approx([x for pair in b for x in pair])


def test_row_bands_go_through_pages_in_turn(spark, capsys):
    """Pages are cut by the batches of a task, marks without a place count as none, and marks are shuffled once."""
    rows = [(k // 3, float(k % 3), "written", i * 20.0 + k, i * 20.0 + k + 14, 900.0) for k in range(60) for i in range(k % 9 + 2)]
    odd = [(r[0], r[1], "ordinal", float("nan"), 3.0, 900.0) for r in rows[::5]] + [(r[0], r[1], "written", None, 3.0, 900.0) for r in rows[::7]] + [(None, 1.0, "written", 1.0, 2.0, 900.0)]
    schema = "k long, nan double, kind string, y0 double, y1 double, height double"
    key = F.when(F.col("nan") == 1, F.lit(float("nan"))).otherwise(F.col("nan"))  # a key that isn't equal to itself
    told = lambda x: {(r.k, str(r.nan), r.n, r.top, r.bottom) for r in x.collect()}
    got = [layout.row_bands(spark.createDataFrame(x, schema).withColumn("nan", key), ["k", "nan"]) for x in (rows, rows + odd)]
    got[0].explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    plain = told(got[0])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert told(got[1]) == plain == told(got[0])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(k, nan) for k, nan, *_ in plain} == {(k // 3, str(float("nan") if k % 3 == 1 else float(k % 3))) for k in range(60)}
    assert len(plain) == sum(k % 9 + 2 for k in range(60))


def test_titles_and_notations(spark):
    titles = {
        "Lista dos viajantes do vapor S. Ana (RV 12) - Dossiê": ("S. Ana", "12", None), "Carga do vapor Norte – ver BR AN,RIO OL.0.RPV, PRJ.77a": ("Norte", None, ("OL", "PRJ", "77A")),
        "vapor Sul. Nota do autor": ("Sul", None, None), "sem nome algum": (None, None, None), "vapor Leste fora da ordem": ("Leste", None, None), "": (None, None, None),
    }
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    got = catalog.title_parts(F.col("t"))
    for r in rows.select("t", *[c.alias(n) for n, c in got.items()]).collect():
        assert (r.ship, r.rv, tuple(r.see_also) if r.see_also else None) == titles[r.t], r.t
    texts = {"br_rjanrio_bs_0_rpv_ent_014231_d0001de0002.pdf": ("BS", "ENT", "014231"), "BR.AN, RIO OL.0.RPV, PRJ. 12b fim": ("OL", "PRJ", "12B"), "BR RJ ANRIO BS 0 RPV": None, "x": None}
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", catalog.notation(F.col("t")).alias("n")).collect():
        assert (tuple(r.n) if r.n else None) == texts[r.t]


def test_measures_on_empty_tables(spark):
    none = spark.createDataFrame([], "k int, printed boolean, left double, right double, rows int")
    assert evaluate.golden(none, none, ["k"]).count() == 0
    assert evaluate.score(spark.createDataFrame([], "a string, b string"), "a", "b").first()["rows"] == 0
    pairs = evaluate.best_match(spark.createDataFrame([(1, "ABC")], "k int, t string"), spark.createDataFrame([], "k int, c string"), ["k"], "t", "c").collect()
    assert [(r.match, r.error) for r in pairs] == [("", 1.0)]


def test_record_queries_keep_every_row(spark):
    customers = spark.createDataFrame([(i, f"CUSTOMER {i}", i % 3, 0.0, "MACHINERY") for i in range(1, 30)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    made = record_queries._dossiers(customers)
    assert made.count() == 29 and records.searchable(made).count() > 0
