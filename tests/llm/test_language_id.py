from __future__ import annotations

import zlib

import zstandard
from pyspark.sql import functions as F

from panelytics.llm import language_id as lid


def test_held_out_accuracy_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 250
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_and_other_columns_are_not_used(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(lid.held_out(F.col("doc_id")), F.lit("wrong")).otherwise(F.col("lang")))
    wrong = wrong.withColumn("source", F.lit(None).cast("string"))
    assert sorted(lid.report(wrong).collect()) == sorted(lid.report(docs).collect())


def test_odd_rows(docs, rows):
    got = lid.report(docs).collect()
    assert len(got) == len(rows)
    letters = lambda t: any(c.isalpha() for c in t or "")
    want = sorted((str(r[0]), letters(r[1])) for r in rows)
    assert sorted((str(r["doc_id"]), r["lang_pred"] != "und") for r in got) == want
    assert all(r["rejected"] and r["score"] == 0 for r in got if r["lang_pred"] == "und")


def test_without_labels_all_is_unknown(docs, no_docs, rows):
    assert lid.report(no_docs).collect() == []
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in lid.report(blank).collect()} == {"und"}
    assert lid.accepted(blank).count() == 0


def test_accepted_rows_stay_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("rejected", F.lit("x"))
    kept = lid.accepted(docs)
    assert kept.columns == docs.columns
    assert kept.exceptAll(docs).count() == 0 and kept.count() > 0.98 * docs.count()


def test_margins_and_whole_texts():
    ready = lid.Compressors({"a": b"the quick brown fox jumps over the lazy dog " * 50, "b": b"lorem ipsum dolor sit amet " * 80})
    assert ready.classify("Lorem ipsum")[0] == "b" and ready.classify("lazy DOG the")[0] == "a"
    long_text = "the quick brown " * 100 + "lorem ipsum dolor sit amet " * 2000
    assert ready.classify(long_text)[0] == "b"
    assert lid.Compressors({"a": b"x"}).classify("word") == ("a", 1.0)
    assert lid.Compressors({}).classify("word") == ("und", 0.0)


def test_every_row_equals_plain_compression(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = lid.dictionaries(docs, ~lid.held_out(F.col("doc_id")))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lid.report(docs).collect()}
    tables = {"window_log": 17, "chain_log": 16, "hash_log": 16}
    flags = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    parameters = zstandard.ZstdCompressionParameters.from_level(6, **tables, **flags)
    plain = {}
    for lang, sample in samples.items():
        raw = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        plain[lang] = zstandard.ZstdCompressor(dict_data=raw, compression_params=parameters)
    for row in docs.collect():
        text = row["text"]
        if not any(c.isalpha() for c in text or ""):
            assert got[row["doc_id"]] == ("und", 0.0)
            continue
        data = f" {' '.join(text.split())} ".lower().encode() if text.split() else b""
        blocks = [data[i : i + 2048] + bytes(32) for i in range(0, len(data), 2048)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in plain.items())
        assert got[row["doc_id"]] == (sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0])


SCHEMA = "doc_id long, text string, lang string"


def test_very_many_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    noise = F.concat(F.lit("noise "), (F.col("doc_id") % 450).cast("string"))
    noisy = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, noise).otherwise(F.col("lang")))
    samples = lid.dictionaries(noisy)
    assert len(samples) > 150 and sum(map(len, samples.values())) <= lid.MODEL_BYTES
    got = lid.identify(noisy.limit(50), samples).collect()
    assert len(got) == 50 and {r["lang_pred"] for r in got} <= {*samples, lid.UNKNOWN}
    many = spark.range(5000).selectExpr("id AS doc_id", "concat('word ', id, ' of a text') AS text", "concat('l', id) AS lang")
    sizes = [len(d) for d in lid.dictionaries(many).values()]
    assert len(sizes) == 5000 and sum(sizes) <= lid.MODEL_BYTES


def test_repeated_and_null_ids_teach_no_more_and_no_less(spark):
    rows = [(7, f"one id on many texts {i}", "a") for i in range(3000)] + [(8, "the same row again", "a")] * 3000
    rows += [(None, f"kein Name {i} dafür", "b") for i in range(50)] + [(i, "", "c") for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["lang"]: r["count"] for r in lid.training_rows(df).groupBy("lang").count().collect()}
    assert found == {"a": lid.SAMPLE_ROWS, "b": 50, "c": 9}
    assert set(lid.dictionaries(df)) == {"a", "b"}
    assert lid.training_rows(df.where("doc_id = 8")).where("lang = 'a'").count() == 1


def test_a_rare_label_changes_no_other_dictionary(spark):
    rows = [(i, f"word{i} in one of very many texts of a language " * 9, "a") for i in range(700)]
    alone = lid.dictionaries(spark.createDataFrame(rows, SCHEMA))
    for size in (1, 7_000, 9_000, 30_000):
        both = lid.dictionaries(spark.createDataFrame([*rows, (-1, "q" * size, "z")], SCHEMA))
        assert both["a"] == alone["a"] and len(both["z"]) == size + 2
    assert len(alone["a"]) == lid.DICTIONARY_BYTES


def test_signs_of_numbers_are_no_letters(spark):
    rows = [(i, text, lang) for i, (text, lang) in enumerate([("plain words", "a"), ("andere Worte", "b"), ("½ ② ³ 7_", None), ("½ ß", None)])]
    samples = lid.dictionaries(spark.createDataFrame(rows, SCHEMA))
    got = {r["doc_id"]: r["lang_pred"] for r in lid.identify(spark.createDataFrame(rows, SCHEMA), samples).collect()}
    assert got[2] == "und" and got[3] != "und"
