"""Profiles of nested JSON by value."""

import json

from ragweave.operators import profiling

TEXTS = [
    '{"a": 1, "b": {"c": [1, "x", null, {"d": true}]}, "e.f": ""}', '{"a": "one", "b": {}, "e.f": "  "}', '{"a": 2.5, "b": [[]]}', "7", None, "{oops", '{"a": 1, "a": 2}',
    '{"s": "brackets ]}[{ and \\" quotes"}', "", "null",
]


def brute(texts):
    """path, kind -> n, n_empty, sizes."""
    out = {}

    def add(path, kind, size=None, empty=False):
        out.setdefault((path, kind), []).append((size, empty))

    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    def walk(path, v):
        if isinstance(v, dict):
            add(path, "object", len(v), not v)
            for k, x in v.items():
                walk(f'{path}."{k}"' if any(c in k for c in '.[]"') else f"{path}.{k}", x)
        elif isinstance(v, list):
            add(path, "array", len(v), not v)
            for x in v:
                walk(f"{path}[]", x)
        elif v is None:
            add(path, "null", None, True)
        elif isinstance(v, bool):
            add(path, "boolean")
        elif isinstance(v, str):
            add(path, "string", len(v), not v.strip(" "))
        else:
            add(path, "integer" if isinstance(v, int) else "decimal")

    for t in texts:
        if t is None:
            add("$", "missing", None, True)
            continue
        try:
            v = json.loads(t, object_pairs_hook=unique)
        except ValueError:
            add("$", "malformed")
            continue
        walk("$", v)
    sums = lambda s: (min(s), max(s), sum(s)) if s else (None, None, None)
    return {k: (len(r), sum(e for _, e in r), *sums([s for s, _ in r if s is not None])) for k, r in out.items()}


def got(df):
    return {(r["path"], r["kind"]): (r["n"], r["n_empty"], r["least_size"], r["most_size"], r["total_size"]) for r in df.collect()}


def test_equals_a_walk_of_every_value(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, path string").withColumnRenamed("path", "v")
    assert got(profiling.nested_profile(df, "v")) == brute(TEXTS)


def test_shards_merge_to_the_whole(spark):
    df = spark.createDataFrame([(i % 3, t) for i, t in enumerate(TEXTS)], "shard int, kind string")
    parts = profiling.nested_profile(df, "kind", ["shard"])
    assert got(profiling.merged(parts)) == brute(TEXTS)
    assert sorted(profiling.merged(parts).collect()) == sorted(profiling.nested_profile(df, "kind").collect())


def test_clashes_and_previews(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    p = profiling.nested_profile(df, "t")
    kinds = {r["path"]: r["kinds"] for r in profiling.clashes(p).collect()}
    assert kinds["$.a"] == ["decimal", "integer", "string"] and kinds["$.b"] == ["array", "object"] and kinds["$.b.c[]"] == ["integer", "object", "string"]
    one = p.where("path = '$.a' and kind = 'string'").head()
    assert (one["least"], one["greatest"]) == ("one", "one")


def test_empty_table_and_deep_text(spark):
    df = spark.createDataFrame([], "t string")
    assert profiling.nested_profile(df, "t").collect() == []
    deep = "[" * 12 + "1" + "]" * 12
    assert got(profiling.nested_profile(spark.createDataFrame([(deep,)], "t string"), "t")) == brute([deep])
