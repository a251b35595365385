import random

from pyspark.sql import functions as F

from lakekeel.sources import scans, sinks


def test_pages_follow_their_tokens(spark, rows):
    rng = random.Random(7)
    pages, want = [], {}
    for s in ("a", "b", None, "single"):
        n = 1 if s == "single" else rng.randrange(20, 70)
        tokens = [None if i == 0 else f"t{rng.randrange(10**9)}" for i in range(n)] + [None]
        for i in range(n):
            pages.append((s, tokens[i], tokens[i + 1], f"{s}{i}"))
            want[f"{s}{i}"] = i
    lost = [("c", "x", "y", "no first"), ("c", "y", None, "behind it"),
            ("d", None, "1", "d0"), ("d", "2", "3", "behind a gap"), ("d", "3", None, "far behind"),
            ("e", None, None, "e0"), ("e", "p", "q", "circle"), ("e", "q", "p", "circle 2"), ("e", "r", "r", "own circle"),
            ("f", None, "1", "f0"), ("f", "1", "2", "twin"), ("f", "1", "2", "other twin"), ("f", "2", None, "behind twins"),
            ("g", None, None, "first"), ("g", None, "1", "second first"), ("g", "1", None, "behind two")]
    want |= {"d0": 0, "e0": 0, "f0": 0}
    every = pages + lost
    rng.shuffle(every)
    df = spark.createDataFrame(every, "s string, token string, next string, body string")
    there, away = scans.ordered_pages(df, "s", "token", "next")
    assert {r.body: r.page_no for r in there.collect()} == want
    assert sorted(r.body for r in away.collect()) == sorted({p[3] for p in every} - set(want))
    none, nothing = scans.ordered_pages(df.limit(0), "s", "token", "next")
    assert none.count() == nothing.count() == 0


def test_identity_goes_on_over_loads(spark, tmp_path):
    path = str(tmp_path / "ids")
    load = lambda keys, n: {r.k: r.id for r in sinks.extend_identity(
        spark.createDataFrame([(k,) for k in keys], "k string"), "k", path, n).collect()}
    assert load(["b", "a", "a", None], 1) == {"a": 1, "b": 2, None: None}
    assert load(["c", "a", "0"], 2) == {"0": 3, "a": 1, "c": 4}
    assert load(["c", "a", "0"], 2) == {"0": 3, "a": 1, "c": 4}  # again
    assert load(["z", "c"], 3) == {"c": 4, "z": 5}
    assert load([], 4) == {} and load(["0", "y"], 5) == {"0": 3, "y": 6}


def test_canonical_json_is_read_back(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, {"b": None, "a": [1.5]}, (2, "x")), (2, None, None)], "i int, m map<string,array<double>>, s struct<z:int,y:string>")
    sinks.write_canonical_json(df, str(tmp_path / "out"))
    text = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert text == ['{"i":1,"m":{"a":[1.5],"b":null},"s":{"y":"x","z":2}}', '{"i":2,"m":null,"s":null}']
    assert rows(spark.read.schema(df.schema).json(str(tmp_path / "out")).select(F.to_json(F.struct("i", "s")))) == rows(df.select(F.to_json(F.struct("i", "s"))))


def test_pages_as_files_share_folders(spark, tmp_path, monkeypatch):
    """As many folders for 500 pages as for 5 million; rows of one id are one page."""
    from lakekeel.bindings import scans as bound

    texts = [(i, f"u{i}", f"<p>\n{i}" if i % 7 else None) for i in range(500)] + [(1, "u1", "<p>\n1"), (None, "u", "x")]
    spark.createDataFrame(texts, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "sf" / "pages.parquet"))
    monkeypatch.setattr(bound, "work_path", lambda spark, label: str(tmp_path / label))
    got = {(r.page_id, r.name): r.text for r in bound.scan_named_text(spark, str(tmp_path / "sf")).collect()}
    html = {i: t or "" for i, _, t in texts[:500]} | {1: "<p>\n1\n<p>\n1"}
    assert got == {(i, "Notes.TXT" if i % 3 == 0 else "notes.txt"): t + "\n" for i, t in html.items() if i % 3 < 2}
    assert sum(p.is_dir() for p in (tmp_path / "texts").rglob("*")) < 4 * 65
