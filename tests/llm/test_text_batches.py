"""Steps over whole texts hold a small Arrow batch at a time, however long the texts of a split are."""

import pyarrow as pa
import pytest

from diegrid.llm import language, ngram_join, secrets, store


def test_bytes_of_a_batch(spark):
    before = spark.conf.get(store.BATCH_BYTES)

    def run(batches):
        for batch in batches:
            yield pa.record_batch({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    texts = spark.range(3000, numPartitions=1).selectExpr("repeat('x', 4000) AS text")
    with store.text_batches(spark):
        seen = store.written(texts.mapInArrow(run, "rows long, bytes long"), "seen").collect()
    assert sum(r["rows"] for r in seen) == 3000
    assert max(r["bytes"] for r in seen) < 1.1 * store.TEXTS
    assert spark.conf.get(store.BATCH_BYTES) == before


@pytest.mark.parametrize("module, run, steps", [
    (ngram_join, lambda docs: ngram_join.components(docs.selectExpr("doc_id AS id", "text")), {"digest", "signs", "edges", "links"}),
    (language, language.identified, {"priors"})])
def test_steps_over_texts(spark, monkeypatch, module, run, steps):
    small = set()

    def noted(df, name):
        if spark.conf.get(store.BATCH_BYTES) == str(store.TEXTS):
            small.add(name)
        return store.written(df, name)

    monkeypatch.setattr(module, "written", noted)
    run(spark.createDataFrame([(i, f"one two three four five {i % 3}", "en", "a.example") for i in range(9)], "doc_id long, text string, lang string, source string")).collect()
    assert small >= steps


def test_parts_of_a_batch(spark, monkeypatch):
    sent = []
    made = pa.RecordBatch.from_arrays

    class Noted:
        @staticmethod
        def from_arrays(arrays, names):
            sent.append(len(arrays[0]))
            return made(arrays, names)

    class Docs:
        columns, schema = ["doc_id", "text"], None

        def mapInArrow(self, run, schema):
            n = 3 * secrets.ROWS + 1
            texts = [None if i % 50 == 0 else f"{i} password=abcdef{i}" if i % 7 == 0 else f"{i} plain" for i in range(n)]
            monkeypatch.setattr(secrets.pa, "RecordBatch", Noted)
            return texts, list(run(iter([made([pa.array(range(n)), pa.array(texts)], self.columns)])))

    texts, out = secrets.redact(Docs())
    assert max(sent) <= secrets.ROWS
    back = pa.Table.from_batches(out).to_pylist()
    assert [r["doc_id"] for r in back] == list(range(len(texts)))
    for r, text in zip(back, texts):
        assert r["text"] == (text if text is None or "password" not in text else f"{r['doc_id']} [SECRET]")


def test_languages_of_large_batches(spark, monkeypatch):
    rows = [(i, None if i % 97 == 0 else ("the cat sat on the mat and the dog " if i % 2 else "le chat est sur la table et le chien ") * 3 + str(i % 5), "en" if i % 2 else "fr", f"h{i % 9}.example") for i in range(1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    found = sorted(map(tuple, language.identified(docs).collect()))
    assert [r[:2] for r in found] == [r[:2] for r in rows if r[1] is not None]
    monkeypatch.setattr(language, "ROWS", 1 << 20)
    assert found == sorted(map(tuple, language.identified(docs).collect()))
