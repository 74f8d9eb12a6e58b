"""Cases that rows, hosts, ids and languages must not get lost in."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boardflow.llm import bitsliced, decontaminate, html_text, langid, linkgraph, mixing, running

PAGES = "page_id long, url string, html string"


def site(i: int, names: bool) -> str:
    menu, ad, foot = (('class="menu"', 'class="ad"', "footer") if names else ("", "", "div"))
    words = [f"w{i}x{j}" for j in range(6)]
    return (
        f"<html><body><div {menu}><ul>" + "".join(f"<li><a href=/{w}>{w}</a></li>" for w in words[: 3 + i % 3]) + f"</ul></div><div {ad}>Buy {i} of {words[0]}</div>"
        f"<article><h1>T{i}</h1><p>One {words[1]}<p>Two</article><{foot}>Page {i} by {words[2]}</{foot}></body></html>"
    )


def test_templates_without_telling_names(spark):
    rows = [(i, f"http://h.org/{i}", site(i, False)) for i in range(20)]
    long = "<p>" + " ".join(f"v{i}" for i in range(60_000))
    rows += [(100 + i, f"http://few{i}.org/", site(50 + i, False)) for i in range(3)] + [(200, "http://h.org/long", f"<article>{long}</article>")]
    # copies of a page without marks are no template
    rows += [(300 + i, "http://copy.org/", "<div>Just this text</div>") for i in range(8)]
    for by_name in (True, False):
        got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, PAGES), by_name=by_name).collect()}
        want = {i: f"T{i}\n\nOne w{i}x1\n\nTwo" for i in range(20)} | {100 + i: f"T{50 + i}\n\nOne w{50 + i}x1\n\nTwo" for i in range(3)}
        assert {i: got[i] for i in want} == want and len(got[200].split()) == 60_000 and all(got[300 + i] == "Just this text" for i in range(8))


def test_letters_and_rare_languages(spark):
    rng = random.Random(1)
    say = {"en": ["the", "house", "old"], "xx": ["qua", "zor", "vim"]}
    rows = [(i, " ".join(rng.choice(say[k]) for _ in range(20)), k) for i in range(900) for k in (["xx"] if i % 150 == 0 else ["en"])]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), max_train=60)
    assert model.languages == ["en", "xx"]
    lang, score = model.predict(pa.array(["½² 12", "zor qua vim", None, "houses", "THE Old"]))
    assert lang[0] == "und" and lang[1] == "xx" and lang[2] == "und" and lang[3] == lang[4] == "en" and score[0] == 0


def test_proximity_does_not_depend_on_partitions(spark):
    rows = [(1, "alpha x beta gamma"), (2, "alpha alpha alpha alpha " + "y " * 60 + "beta"), (None, "gamma beta alpha")]
    items = spark.createDataFrame([(5, "alpha beta gamma"), (None, "x"), (6, None)], "item_id long, text string")
    found = []
    for n in (1, 3):
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        found.append(sorted(map(str, decontaminate.proximity(table, items, 2, 8).collect())))
    assert found[0] == found[1] and len(found[0]) == 2


def cheapest(patterns, quotas, most):
    """Least cost of the largest total, by trying all that patterns may give to sources."""
    keys = sorted(patterns)
    best = {(0,) * len(quotas): 0}
    names = sorted(quotas)
    for k in keys:
        after = {}
        room = most * patterns[k]
        spots = [names.index(s) for s in k]
        for got, cost in best.items():
            splits = [()]
            for _ in spots:
                splits = [s + (v,) for s in splits for v in range(room - sum(s) + 1)]
            for split in splits:
                new = list(got)
                for i, v in zip(spots, split, strict=True):
                    new[i] += v
                if all(v <= quotas[n] for v, n in zip(new, names, strict=True)):
                    given = sum(split)
                    c = cost + sum(n // patterns[k] for n in range(given))
                    if c < after.get(tuple(new), 1 << 30):
                        after[tuple(new)] = c
        best = after
    top = max(map(sum, best))
    return top, min(c for g, c in best.items() if sum(g) == top)


def test_flow_is_cheapest():
    rng = random.Random(5)
    for _ in range(25):
        patterns = {k: rng.randint(1, 3) for k in rng.sample([("a",), ("b",), ("a", "b"), ("c",), ("b", "c")], 3)}
        quotas = {s: rng.randint(0, 5) for s in "abc"}
        given = mixing.route(patterns, quotas, 2)
        assert (sum(given.values()), sum(n // patterns[k] for k, g in given.items() for n in range(g))) == cheapest(patterns, quotas, 2)


def test_running_sums_by_levels(spark, monkeypatch):
    monkeypatch.setattr(running, "FAN", 4)
    rows = [(g, b, (g * 7 + b * 3) % 5) for g in (1, 2) for b in range(0, 100, 1 + g)]
    got = running.starts(spark.createDataFrame(rows, "g int, bucket long, v long"), ["g"], "v", 100).collect()
    assert {(r["g"], r["bucket"]): r["start"] for r in got} == {(g, b): sum(v for h, c, v in rows if h == g and c < b) for g, b, _ in rows}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20)))], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def test_stages_lose_no_rows(spark, folder):
    """Null ids, repeated rows and columns whose names the stages use themselves."""
    text = [" ".join(f"t{i}w{j}" for j in range(30)) for i in range(6)]
    rows = [(None, t, "s") for t in text] + [(7, text[0], "s"), (7, text[0], "s"), (8, None, None), (8, "", None), (9, " ".join(f"b{i}" for i in range(20)), "s")]
    docs = spark.createDataFrame([(*r, 1.0, 2, 3, 4) for r in rows], "doc_id long, text string, source string, quality_score double, times int, nth int, row int")
    near = corpus_pipeline.keep_first_of_near_copies(spark, docs, folder)
    assert near.columns == docs.columns and sorted(r["text"] or "" for r in near.collect()) == sorted([*text, "", "", rows[-1][1]])
    clean = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert clean.count() == len(rows) - 1 and clean.where("doc_id = 9").isEmpty()
    assert corpus_pipeline.keep_quality(spark, docs, folder).columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, docs, folder).collect()
    # eight texts of 30 words and one of 20 share 150 %: some are read twice, and rows without an id are among them
    assert len(mixed) >= 9 and any(r["doc_id"] is None for r in mixed) and {(r["times"], r["nth"], r["row"]) for r in mixed} == {(2, 3, 4)}
    assert corpus_pipeline.assign_shards(spark, docs, folder).count() == len(rows)


def test_odd_items_vectors_and_ties(spark):
    """Items without an id, very long and repeated ones; clashing columns everywhere; a host just at the factor."""
    rng = random.Random(21)
    long = [f"v{rng.randrange(5000)}" for _ in range(30_000)]
    rows = [(1, " ".join(long[100:140])), (2, " ".join(long[20_000:20_012])), (3, "only this here"), (3, "only this here"), (None, "only this here"), (4, " ".join(long))]
    items = [(10, " ".join(long)), (None, "only this"), (11, "this here"), (11, "this here")]
    docs = spark.createDataFrame([(*r, 7, 7, "x", 7) for r in rows], "doc_id long, text string, n_words long, n_hit long, items string, item_id long")
    table = spark.createDataFrame([(*i, 7, "x", 7) for i in items], "item_id long, text string, doc_id long, terms string, n long")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(docs, table).collect()), key=str)
    # an item without an id hits words, but isn't counted; of items that repeat, one is
    assert got == sorted([(1, 40, 40, 1), (2, 12, 0, 0), *[(k, 3, 3, 1) for k in (3, 3, None)], (4, 30_000, 30_000, 1)], key=str)

    vectors = spark.createDataFrame([(i, [float(i), 1.0], 5, 5, 5) for i in range(60)], "vec_id long, embedding array<double>, rank int, score long, query_id long")
    best = bitsliced.top_k(vectors, F.col("vec_id") % 50 == 0).where("query_id = 50").orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in best] == [(k + 1, 59 - k, 65536 * (50 * (59 - k) + 1)) for k in range(5)]

    # both hosts get as much trust as distrust: with a factor of 1 that is a tie, and allowed
    page = "<a href='//b.com/'>"
    pages = spark.createDataFrame([(i, u, h, "x", "x") for i, u, h in [(1, "http://a.com/fr/", page), (2, "http://a.com/de/", page), (3, "http://a.com/x", None), (4, "http://a.com/x", None)]], "page_id long, url string, html string, kind string, host string")
    for factor, verdict in ((1.0, "allow"), (0.9, "block")):
        assert [r["verdict"] for r in linkgraph.judge(pages, factor=factor).where("page_id > 2").collect()] == [verdict] * 2
