"""The pipeline and the registered queries against brute force."""

import collections
import hashlib
import random

import pytest

import corpus_pipeline
from ragweave.llm import linededup, pieces, quality, queries
from tests.llm.test_corpus_operators import brute_classes, brute_lines, plain_targets

WORDS = ["".join(random.Random(i).choices("abcdefghijklmnop", k=4)) for i in range(900)]


def corpus(seed=1):
    r = random.Random(seed)
    line = lambda n: " ".join(r.choices(WORDS, k=n))
    rows = []
    for _ in range(50):
        text = "\n".join(line(r.randint(6, 30)) for _ in range(r.randint(2, 6)))
        rows.append(text)
        if r.random() < 0.3:  # a near copy: words in most lines differ
            rows.append("\n".join(" ".join(w if r.random() > 0.04 else r.choice(WORDS) for w in x.split()) for x in text.split("\n")))
    rows += [line(60).replace(" ", "%%% ") for _ in range(6)] + ["a b c", "", "x y z q w " * 20, rows[0], rows[1] + "\n" + line(12)]
    r.shuffle(rows)
    return [(i, t, r.choice(["en", "de"]), r.choice(["src0", "src1", "src1", "src1", None]), len(t or "")) for i, t in enumerate([*rows, None])]


def table(spark, rows, folder):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    df.repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages(spark, tmp_path):
    docs = table(spark, corpus(), str(tmp_path))
    columns = docs.columns
    kept = {r["doc_id"] for r in quality.judge(docs).collect() if r["kept"]}
    after = docs
    seen = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r[c] for c in columns) for r in after.collect()] if n < 5 else []
        out = stage(spark, after, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{n}"))
        after = spark.read.parquet(str(tmp_path / f"s{n}"))
        rows = after.collect()
        seen.append((name, len(rows)))
        if n < 4:
            assert after.columns == columns
        if n == 0:
            assert {r["doc_id"] for r in rows} == kept and 40 <= len(kept) < docs.count()
        if n == 1:
            gone = brute_lines([x[:2] for x in before])
            want = {}
            for i, t, *_ in before:
                left = [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone]
                if any(x.split() for x in left):
                    want[i] = "\n".join(left)
            assert {r["doc_id"]: r["text"] for r in rows} == want
        if n == 2:
            assert sorted(r["doc_id"] for r in rows) == sorted(set(brute_classes([x[:2] for x in before]).values()))
        if n == 3:
            sizes, taken = collections.Counter(), collections.Counter()
            for x in before:
                sizes[x[3]] += len(x[1].split())
            for r in rows:
                taken[r["source"]] += len(r["text"].split())
            longest = max(len(x[1].split()) for x in before)
            assert all(abs(taken[s] - t) <= longest for s, t in plain_targets(sizes).items())
            assert max(collections.Counter(r["doc_id"] for r in rows).values()) <= 3
        if n == 4:
            enc = pieces.encoder(pieces.default_model())
            digest = {i: hashlib.sha256(" ".join(map(str, enc.model.encode(t, add_eos=True))).encode()).hexdigest() for i, t, *_ in before}
            assert sorted((r["doc_id"], r["ids_sha256"]) for r in rows) == sorted((x[0], digest[x[0]]) for x in before)
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted((r["doc_id"], r["ids_sha256"]) for r in rows), seen


def test_empty_corpus(spark, tmp_path):
    table(spark, [], str(tmp_path))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None and linededup.MIN_WORDS == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, tmp_path, name):
    import duckdb

    table(spark, corpus(2), str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = duck.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in want.description)
    rows = lambda got: sorted(repr([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in names]) for r in got)
    expected = rows(dict(zip([d[0] for d in want.description], r, strict=True)) for r in want.fetchall())
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(got.columns) == names and rows(got.collect()) == expected
