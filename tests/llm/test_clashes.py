"""Operators on tables whose columns are called like the operators' own, with NULLs, repeats and no rows."""

from pathlib import Path

import public_tokenizers
import pytest

from tallystream.llm import audio_media, decontaminate, html_extract, lm_scoring, mixing, resample, secret_scan, simhash, spelling, suffix_dedup, token_ids, toxicity

NAMES = ["_k", "_t", "_raw", "_open", "_score", "_text", "_h", "base_spans", "secret_spans", "media", "_block", "fp", "_fp", "node", "root", "low", "_key", "quota", "_words", "taken", "size", "_from", "_s", "_size"]
TEXTS = [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (None, "password=abcd1234efgh no id"), (None, "password=abcd1234efgh no id")]


@pytest.fixture(scope="module")
def wide(spark):
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, "s", *(f"{n}:{k}" for n in NAMES)) for k, (i, t) in enumerate(TEXTS)], schema)


def extra(df):
    return sorted(str(tuple(r[n] for n in NAMES)) for r in df.collect())


def test_names_are_carried(spark, wide):
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(0, "one two three")], "item_id long, text string")
    for df in (toxicity.without_toxic(wide, labels), decontaminate.without_contaminated(wide, bench), secret_scan.redact(wide)):
        assert df.columns == wide.columns and extra(df) == extra(wide)
    scored = toxicity.score(wide, toxicity.Model(b" ", b" ", []))
    assert scored.columns == [*wide.columns, "score"] and extra(scored) == extra(wide)
    one = simhash.keep_one(wide)
    assert one.columns == wide.columns and {r.doc_id for r in one.collect()} == {1, 2, None}
    stored = audio_media.store(wide)
    assert set(wide.columns) - {"media"} <= set(stored.columns) and {r._raw for r in stored.collect()} == {f"_raw:{k}" for k in range(len(TEXTS))}
    pages = wide.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("source", "url")
    assert html_extract.extract(pages).count() == len(TEXTS)
    mixed = mixing.mix(wide, carry=["text", *NAMES])
    assert mixed.count() == len(TEXTS)


def test_names_beside_the_operators_own(wide):
    """Operators that give their own columns only: one row for each row, whatever else the table holds."""
    n = len(TEXTS)
    assert lm_scoring.score(wide).count() == n and lm_scoring.score(wide.limit(0)).count() == 0
    assert suffix_dedup.digest(suffix_dedup.dedup(wide)).count() == n and suffix_dedup.dedup(wide.limit(0)).count() == 0
    found = simhash.components(wide)
    assert found.count() == n and simhash.components(wide.limit(0)).count() == 0
    assert {r.doc_id: r.component_id for r in found.filter("doc_id IN (2, 3)").collect()} == {2: 2, 3: 2}
    assert {r.text for r in mixing.corpus(wide).collect()} <= {t for _, t in TEXTS if t} and mixing.corpus(wide.limit(0)).count() == 0
    tokenizer = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    assert token_ids.stored(wide, tokenizer).count() == n
    assert resample.draw(wide, wide).count() == n and resample.drawn(wide, wide, least=1, percent=100).columns == wide.columns
    assert {r.word for r in spelling.variants(spelling.words(wide, least_count=1)).collect()} >= {"alpha", "delta"}
