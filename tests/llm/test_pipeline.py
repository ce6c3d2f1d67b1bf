"""The pipeline, each stage against plain Python or SQL on what the stage before kept; and on awkward tables."""

import random
import uuid
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from oracle import compare
from test_mixing import WORDS, targets
from test_near_copies import expected
from test_secrets import redacted

import corpus_pipeline
from tallystream.llm import oracle
from tallystream.llm import queries as llm

D = "/root/testdata/sf0.001"


def stages(spark, d):
    """The rows that each stage returns, the first being the table itself."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out, base = [docs], f"{spark.conf.get('spark.checkpoint.dir')}/test-{uuid.uuid4().hex}"
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], d).write.parquet(f"{base}/{name}")
        out.append(spark.read.parquet(f"{base}/{name}"))
    return [[tuple(r) for r in x.collect()] for x in out], [x.columns for x in out]


def check(rows, columns, d):
    """rows are (doc_id, text, lang, source, n_chars, ...)."""
    given, mild, single, clean, safe, mixed = rows
    assert all(c == columns[0] for c in columns[:-1]) and columns[-1] == [*columns[0], "copy", "words"]
    at = {c: i for i, c in enumerate(columns[0])}
    pair = lambda r: (r[at["doc_id"]], r[at["text"]])
    assert not Counter(mild) - Counter(given) and not Counter(single) - Counter(mild) and not Counter(clean) - Counter(single)
    left = Counter(map(pair, single))
    want = expected([pair(r) for r in mild])
    assert len(single) == len(want)
    for (null, k), texts in want:
        assert any((i is None, i or 0) == (null, k) and t in texts for i, t in left)
    c = duckdb.connect()
    c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    if single:
        c.executemany("INSERT INTO documents VALUES (?, ?)", [pair(r) for r in single])
    table = Path(d, "benchmark.parquet")
    c.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{f'{table}/*.parquet' if table.is_dir() else table}'")
    bad = {r[0] for r in c.sql(f"SELECT doc_id FROM ({oracle.templates()}) WHERE doc_id IS NOT NULL").fetchall()}
    assert Counter(clean) == Counter(r for r in single if r[at["doc_id"]] not in bad)
    shown = lambda r: tuple(None if r[i] is None else redacted(r[i]) if i == at["text"] else r[i] for i in range(len(r)))
    assert Counter(safe) == Counter(map(shown, clean))
    source = at["source"]
    size, wanted = targets([(r[at["doc_id"]], r[at["text"]], r[source], None) for r in safe]) if safe else ({}, {})
    taken, by_row = Counter(), Counter()
    for r in mixed:
        n = len(WORDS.findall(r[at["text"]] or ""))
        assert n == r[-1] > 0
        taken[r[source]] += n
        by_row[r[at["doc_id"]], *(x for i, x in enumerate(r[:-2]) if i not in (at["text"], at["doc_id"]))] += n
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in size)
    for r in safe:
        assert by_row[r[at["doc_id"]], *(x for i, x in enumerate(r) if i not in (at["text"], at["doc_id"]))] <= 3 * sum(len(WORDS.findall(x[at["text"]] or "")) for x in safe if x[at["doc_id"]] == r[at["doc_id"]])
    return bad


def test_pipeline(spark):
    rows, columns = stages(spark, D)
    assert check(rows, columns, D) and len(rows[1]) > 150 and len(rows[-1]) > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secret_scans", "mixing"]
    got = corpus_pipeline.run(spark, D)
    assert Counter(map(tuple, got.collect())) == Counter(rows[-1]) and got.columns == columns[-1]


def test_awkward_tables(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    toxic = lambda: " ".join([*text(40).split(), *["blorkish", "grumpfen", "zwackel"] * 2])
    item = "Anna has 12 red apples and buys 7 more at the small market, how many apples does she hold after 3 days"
    docs, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        docs.append((i, toxic() if bad else text(60), rng.choice(["a", "b", None])))
        labels.append((i, 1, int(bad)))
    near = text(200)
    docs += [(400, near, "a"), (401, near.replace(near.split()[100], "x"), "b"), (400, near, "a"), (None, near, "a"), (402, text(30) + " " + item, "a"), (403, "password=abcd1234efgh " + text(30), None)]
    docs += [(404, None, "a"), (405, "", "b"), (406, " \t", None), (407, "tiny", "only"), (None, text(20), "a"), (None, text(20), "a"), (408, text(4000), "b")]
    more = [(*r[:2], "en", r[2], None if r[1] is None else len(r[1]), f"k{k}", "s") for k, r in enumerate(docs)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _k string, score string"
    names = {"documents": (more, schema), "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": ([(0, item), (1, None)], "item_id long, text string")}
    for name, (rows, kind) in names.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "full" / f"{name}.parquet"))
        spark.createDataFrame([], kind).coalesce(1).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    rows, columns = stages(spark, str(tmp_path / "full"))
    assert check(rows, columns, str(tmp_path / "full")) == {402}
    gone = {r[0] for r in rows[0]} - {r[0] for r in rows[1]}
    assert len(gone) >= 90 and all(i % 3 == 0 and i < 300 for i in gone)
    assert any(r[1] and "[SECRET]" in r[1] for r in rows[-1]) and any(r[0] == 407 for r in rows[-1]) and any(r[0] == 408 for r in rows[-1])
    assert not [r for r in corpus_pipeline.run(spark, str(tmp_path / "none")).collect()]


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_oracle(spark, name):
    compare(spark, name, llm.queries()[name], llm.oracle_sql()[name], "/root/testdata/sf0.01")
