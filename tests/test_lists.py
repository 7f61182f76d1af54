"""Carry-forward against a sequential model, runs, breaks, forms, catalogues, dictionaries, records."""

import random

from pyspark.sql import functions as F

from brinewood.functions import text as t
from brinewood.operators import carry, catalog, extract, lexicon, records


def model(rows):
    """One page in order: (reading, surname, indent) to (surname, source)."""
    last, since, out = None, 0, []
    marks = set(t.MARK_CHARS)
    is_mark = lambda x: bool(x) and (x.lower() in t.MARK_WORDS or all(c in marks for c in x))
    for reading, surname, indent in rows:
        words = reading.split()
        near = last is not None and since <= 2
        if not words:
            since += 1
            out.append((surname, None))
            continue
        whole = is_mark(reading)
        stripped = reading.lstrip(t.MARK_CHARS)
        lead = not whole and (is_mark(words[0]) or (stripped != reading and sum(c.isalpha() for c in stripped) >= 3))
        if len(words) == 1 and not whole and not lead and indent >= 0.18 and near:
            out.append((last, "indent"))
        elif (lead or whole) and near:
            out.append((last, "mark"))
        elif len(words) >= 2 and surname and not is_mark(surname):
            last = surname
            out.append((surname, None))
        elif len(words) == 1 and not whole and near:
            out.append((last, "position"))
        else:
            out.append((surname, None))
        since = 0
    return out


def test_carry_forward_equals_the_sequential_model(spark):
    rng = random.Random(3)
    kinds = ["", "", "Silva Ana", "Roca Luis", '"', '" Joze', '"Joze', "Maria", ", Ana Bela", "ii"]
    data, want = [], {}
    for page in range(120):
        rows = []
        for n in range(rng.randint(1, 14)):
            reading = rng.choice(kinds)
            w = reading.split()
            surname = " ".join(w[:-1]) if len(w) > 1 else (w[0] if w else None)
            rows.append((reading, surname, rng.choice([0.0, 0.3])))
            data.append((page, n, reading, surname, w[-1] if len(w) > 1 else "", rows[-1][2]))
        want |= {(page, n): x for n, x in enumerate(model(rows))}
    df = spark.createDataFrame(data, "page int, n int, name_raw string, surname string, given string, indent double")
    got = carry.carry_forward(df, ["page"], ["n"], indent="indent").collect()
    assert {(r.page, r.n): (r.surname, r.ditto_source) for r in got} == want
    assert all(r.name_raw == d[2] for r, d in zip(sorted(got, key=lambda r: (r.page, r.n)), data, strict=True))


def test_list_breaks(spark):
    rows = spark.createDataFrame([("a", i, o) for i, o in enumerate(["1", "2", "3", "4", "", "1", "2", "3"])] + [("b", i, o) for i, o in enumerate(["8", "9", "10", "1", "2"])], "doc string, n int, ordinal string")
    assert [(r.doc, r.n) for r in carry.list_breaks(rows, ["doc"], ["n"], "ordinal").collect()] == [("a", 5)]


def test_gap_and_runs(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate("aabba")], "g int, n int, x string")
    assert [r.run for r in carry.run_ids(rows, ["g"], ["n"], "x").orderBy("n").collect()] == [1, 1, 2, 2, 3]
    assert [r.gap for r in carry.gap_before(rows, ["g"], ["n"], F.col("x") == "a").orderBy("n").collect()] == [None, 0, 0, 1, 2]


def test_value_beside_and_dateline(spark):
    text = "Vapor: ITAPUCA\nporto de\nSantos, 4 de maio de\n1912"
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "d long, text string")
    lines = extract.lines_of(docs, ["d"])
    got = extract.value_beside(lines, ["d"], r"Vapor:\s*(.*)", F.col("line").rlike("Vapor:")).collect()
    assert [(r.d, r.value) for r in got] == [(1, "ITAPUCA")]
    assert [(r.d, r.arrival) for r in extract.dateline(lines, ["d"], {"maio": 5, "abril": 4}).collect()] == [(1, "1912-05-04")]


def test_merge_prefers_printed_years(spark):
    rows = spark.createDataFrame([(1, 1, None, 1911, "stamp"), (1, 2, "A", 1912, "printed"), (2, 1, "B", None, None)], "d int, n int, ship string, year int, year_source string")
    got = {r.d: r for r in extract.merge_records(rows, ["d"], ["n"], ["ship"], "year", "year_source").collect()}
    assert (got[1].ship, got[1].year, got[1].year_source) == ("A", 1912, "printed")
    assert (got[2].ship, got[2].year) == ("B", None)


def test_wrapped_entries_and_catalogues(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["chrome", "E 1 - one", "two", "", "three", "E 2 - x"])], "d int, pos int, line string")
    got = catalog.join_wrapped(lines, ["d"], F.col("line").startswith("E "), F.col("line") == "").orderBy("entry").collect()
    assert [(r.text, r.n_lines) for r in got] == [("E 1 - one two", 2), ("E 2 - x", 1)]
    rows = spark.createDataFrame([("14091A",), ("7",), ("1234567",)], "i string")
    assert [r.x for r in rows.select(catalog.padded_index(F.col("i"), F.lit(6)).alias("x")).collect()] == ["014091A", "000007", "1234567"]
    rec = spark.createDataFrame([("f", ""), ("g", "P"), ("h", None)], "file string, ship string")
    cat = spark.createDataFrame([("f", "C"), ("g", "C")], "file string, ship string")
    assert {r.file: r.ship for r in catalog.fill_from(rec, cat, "file", "ship").collect()} == {"f": "C", "g": "P", "h": None}


def test_dictionary(spark):
    names = spark.createDataFrame([("SILVA", 9), ("SILVIA", 3), ("ROCA", 2)], "name string, seen long")
    seen = spark.createDataFrame([("SYLVA",), ("SILVA",), ("QQQQQ",)], "observed string")
    got = {(r.observed, r["rank"]): r.name for r in lexicon.suggest(seen, names).collect()}
    assert got[("SYLVA", 1)] == "SILVA" and got[("SILVA", 1)] == "SILVIA" and not any(o == "QQQQQ" for o, _ in got)
    rows = spark.createDataFrame([(1, "Sylva Zzzz"), (2, "Zzzz Qqqq")], "k int, text string")
    assert {r.k: r.doubtful for r in lexicon.doubtful(rows, ["k"], "text", names).collect()} == {1: False, 2: True}
    spelt = spark.createDataFrame([("itapuca", 5), ("itapuco", 1), ("formosa", 2)], "name string, seen long")
    assert {r.name: (r.label, r.size) for r in lexicon.cluster(spelt).collect()} == {"itapuca": ("itapuca", 6), "itapuco": ("itapuca", 6), "formosa": ("formosa", 2)}


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schema": 18, "engine": "e", "hash": "a", "voyage": {"ship": ""}, "rows": [{"n": 1, "page": 1, "name_raw": "Silva"}]}')
    (tmp_path / "b.json").write_text('{"schema": 19, "engine": "e", "hash": "b", "rows": [{"n": 1, "page": 1}]}')
    (tmp_path / "c.json").write_text("{broken")
    from brinewood.sources.tables import records as scan

    rows = records.flatten(scan(spark, str(tmp_path))).collect()
    assert [(r.doc, r.n, r.name_raw, r.ship) for r in rows] == [("a", 1, "Silva", None)]
    human = spark.createDataFrame([(1, "h", True), (2, "m", False), (3, None, True)], "k int, v string, by_hand boolean")
    fresh = spark.createDataFrame([(1, "f"), (2, "f"), (3, "f"), (4, "f")], "k int, v string")
    got = {r.k: r.v for r in records.prefer_human(human, fresh, "k", "v", "by_hand").collect()}
    assert got == {1: "h", 2: "f", 3: "f", 4: "f"}


def test_incremental_stream(spark, tmp_path):
    from brinewood.streaming.incremental import index_folder

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    rows.write.parquet(src)
    work = lambda df: df.withColumn("error", F.when(F.col("v").isNull(), F.lit("empty")))
    for _ in range(2):
        index_folder(spark, src, rows.schema, work, out, ck, errors=str(tmp_path / "err")).awaitTermination()
    assert spark.read.parquet(out).count() == 1 and spark.read.parquet(str(tmp_path / "err")).count() == 1
    rows.write.mode("append").parquet(src)
    index_folder(spark, src, rows.schema, work, out, ck, errors=str(tmp_path / "err")).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_identity_titles_and_addresses(spark):
    rows = spark.createDataFrame([("BR_RJANRIO_BS_0_RPV_ENT_017397_d0001.pdf", None), ("x.pdf", "NOTAÇÃO: BR.AN.RIO.OL.0.RPV.PRJ. 15992"), ("x.pdf", None)], "f string, c string")
    got = catalog.identify(F.col("f"), F.col("c"), F.lit("0123456789"))
    assert [tuple(r) for r in rows.select(*[v.alias(k) for k, v in got.items()]).collect()] == [
        ("BS.ENT.017397", "filename", "BS.ENT.017397"), ("OL.PRJ.15992", "cover", "OL.PRJ.15992"), (None, "unknown", "sem notação (01234567)"),
    ]
    titles = spark.createDataFrame([("relação de passageiros do vapor itaquera. - Dossiê",), ("vapor x (rv 12) - ver br an,rio ol.0.rpv, prj.18784",), ("cover - Item",), (None,)], "t string")
    parts = catalog.title_parts(F.col("t"))
    got = titles.select(*[v.alias(k) for k, v in parts.items()]).collect()
    assert [r.ship for r in got] == ["itaquera", "x", None, None] and got[1].rv == "12" and tuple(got[1].see_also) == ("OL", "PRJ", "18784")
    at = catalog.address(F.lit("b"), F.lit("BS"), F.lit("ENT"), F.lit("7A"), F.lit(6), F.lit(1), F.lit(2))
    assert spark.range(1).select(at.alias("x")).first().x == "b/BR_RJANRIO_BS/0/RPV/ENT/000007A/BR_RJANRIO_BS_0_RPV_ENT_000007A_d0001de0002.pdf"


def test_find_richer_bands_and_columns(spark):
    rows = spark.createDataFrame([(1, "VAZQUEZ", "JOHN"), (2, "VASQUEZ", "ANA"), (3, "ROCA", "PAULO")], "n int, surname string, given string")
    assert {r.n for r in records.find_in_document(rows, "vasquez", ["surname"]).collect()} == {1, 2}
    assert {r.n for r in records.find_in_document(rows, "joao", ["given"], 0.6, {"joao": ["john"]}).collect()} == {1}
    assert records.find_in_document(rows, "paulo", ["surname"]).count() == 0
    a = spark.createDataFrame([(1, 1, ""), (1, 2, "x"), (2, 1, "y")], "p int, n int, t string")
    b = spark.createDataFrame([(1, 1, "z"), (1, 2, "x"), (2, 1, "q")], "p int, n int, t string")
    assert sorted(r.t for r in records.richer(a, b, ["p"], "t").collect()) == ["x", "y", "z"]
    bands = spark.createDataFrame([(1, 1), (1, 2)], "p int, n int")
    read = spark.createDataFrame([(1, 2, "Silva", 0.9)], "p int, n int, text string, confidence double")
    assert [(r.n, r.name_raw, r.conf) for r in records.rows_from_bands(bands, read, ["p"]).orderBy("n").collect()] == [(1, "", 0.0), (2, "Silva", 0.9)]
    cols = F.array(*[F.lit(x) for x in (0.0, 0.1, 0.5, 0.6)])
    assert spark.range(1).select(records.widest_pair(cols).alias("x")).first().x == [0.1, 0.5]


def test_a_title_is_folded_once(spark):
    """Its words are named and then read: their plan stands in a title's plan a few times, not once per place that asks for a word."""
    got = catalog.title_parts(F.col("t"))
    rows = spark.createDataFrame([("quadro de embarque do vapor Alva (rv 4) - ver br an,rio ol.0.rpv, prj.12. - Dossiê",)], "t string").select(*[v.alias(k) for k, v in got.items()])
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_replace") < 60
    r = rows.first()
    assert r.ship == "Alva" and r.rv == "4" and tuple(r.see_also) == ("OL", "PRJ", "12")
