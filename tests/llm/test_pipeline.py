import corpus_pipeline
from pyspark.sql import functions as F

from tidewater.llm import language_id, simhash
from tidewater.llm.sentencepieces import _model, codec


def test_stages_take_effect(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 100)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        def kept(s, d, sf, name=name, stage=stage):
            out = stage(s, d, sf)
            seen[name] = (d, out)
            return out

        monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, kept if n == name else f) for n, f in corpus_pipeline.STAGES])
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.columns == [*docs.columns, "ids", "n_tokens", "ids_crc32", "round_trip", "parity"]
    for name in ("language_id", "simhash", "secret_scan", "mixing"):
        assert seen[name][1].columns == docs.columns
    after = spark.createDataFrame(seen["simhash"][1].toPandas(), docs.schema)
    assert simhash.near_duplicates(after).where("doc_id <> component_id").count() == 0
    rows = out.collect()
    assert rows and all(r.parity and r.round_trip for r in rows)
    assert all(codec(_model()).decode(__import__("numpy").array(r.ids)) == r.text for r in rows[:20])
    assert out.where(F.col("text").rlike('token = "[0-9a-f]{40}"|AKIA[A-Z0-9]{16}')).count() == 0


def test_odd_rows_and_empty_table(spark, monkeypatch, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, and columns that are called like the stages' own."""
    monkeypatch.setattr(language_id, "STEPS", 150)
    english = "the reader was on the table and the light of the house under seven words with the others of that day "
    german = "der mann und die frau sind in dem haus nicht mit den kindern und der hund ist auch noch bei ihnen heute "
    rows = [(i, (english if i % 2 else german) + f"number{i} " * (i % 5 + 1), "en" if i % 2 else "de", None if i % 7 == 0 else "abc"[i % 3], 1) for i in range(1, 60)]
    rows += [(None, english * 3, "en", "a", 5), (None, english * 3, "en", "a", 5), (200, None, None, None, None), (201, "", "en", "a", 0), (202, "123 !?", None, "b", 6), (1, english + "number1 number1 ", "en", "b", 1)]
    rows += [(203, german * 2000, "de", "a", 9), (204, english + 'password="hunter2!Tr0ub4d"', "en", "a", 9), (205, english + 'password="hunter2!Tr0ub4d"', "en", "a", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, _row int, size long, key string, hash string, same string"
    docs = spark.createDataFrame([(*r, "i", 3, 4, "k", "h", "s") for r in rows], schema)
    docs.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert out.columns == [*docs.columns, "piece_ids", "n_tokens", "ids_crc32", "round_trip", "parity"]
    got = out.collect()
    assert got and all(r.parity and r.round_trip and r.ids == "i" and r._row == 3 and r.hash == "h" for r in got)
    assert not {200, 201, 202} & {r.doc_id for r in got} and not any("hunter2" in r.text for r in got)
    docs.where("doc_id < 0").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_keep_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = simhash.stage(spark, docs, "").collect()
    own = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert {r.doc_id for r in kept} == set(own.values())
    sets = {r.doc_id: {tuple(x) for x in zip(*(r.text.lower().split()[k:] for k in range(5)))} for r in docs.where("text is not null").collect()}
    for i, c in own.items():  # against all pairs: what stays apart isn't similar, and the other way round
        for j, d in own.items():
            a, b = sets.get(i), sets.get(j)
            if a and b and i < j and len(a & b) >= 0.8 * len(a | b):
                assert c == d, (i, j)
