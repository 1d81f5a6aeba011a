"""Quality trees, decontamination, WARC archives, URL verdicts, chat trees and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import io
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from marketlens.llm import chat_tree, decontaminate, quality, queries, url_filter, warc
from marketlens.llm.common import read_table
from tests.llm.helpers import SCHEMA, documents, frame
from tests.oracle_check import connect, differences

SF = "/root/testdata/sf0.001"


def test_trees_score_as_a_walk_over_each_tree():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = quality.fit(x[:1000], y[:1000])
    scores = trees.score(x)
    assert ((scores[1000:] >= 0.5) == y[1000:]).mean() > 0.93
    binned = trees.bins(x[:50])
    for row in range(50):
        total = trees.base
        for t in range(quality.TREES):
            node = 1
            for _ in range(quality.DEPTH):
                node = 2 * node + int(binned[row, trees.feature[t, node]] > trees.split[t, node])
            total += trees.leaf[t, node - (1 << quality.DEPTH)]
        assert scores[row] == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality.fit(x[:10], np.ones(10)).score(x)[0] == pytest.approx(11 / 12)


def test_statistics_do_not_depend_on_neighbours():
    texts = [(r[1] or "").encode() for r in documents(n=20)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    whole = quality.statistics(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])
    assert np.isfinite(whole).all() and whole.shape[1] == quality.FEATURES


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_quality(spark, sf).toPandas()
    labels = read_table(spark, sf, "labels").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert 0.2 < got.held_out.mean() < 0.3 and (held.predicted == held.quality).mean() > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", "c"), (1, None, "a")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 1)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_contamination_equals_sql(spark):
    assert differences(queries.op4_decontaminate(spark, SF), connect(SF), decontaminate.ORACLE) == []


def test_contamination_edges(spark):
    rng = random.Random(1)
    item = [f"q{i}" for i in range(20)]
    filler = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    docs = [
        (1, " ".join(filler(5) + item[3:16] + filler(5))),  # one whole window
        (2, " ".join(filler(5) + item[3:15] + filler(5))),  # a word short
        (3, "Two-WORDS, here"),
        (4, " ".join(filler(300) + ["two", "words"] + filler(300))),  # hit, but under a twentieth
        (5, None), (6, ""), (7, "..."), (None, " ".join(item)), (1, " ".join(item)), (1, " ".join(item)),
    ]
    items = [(10, " ".join(item)), (9, "two words!"), (9, "two words!"), (8, None), (7, ""), (None, "two words"), (11, " ".join(item))]
    docs = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_words string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()]
    want = [(1, 23, 13, 2, True), (2, 22, 0, 0, False), (3, 3, 2, 1, True), (4, 602, 2, 1, False), (5, 0, 0, 0, False), (6, 0, 0, 0, False), (7, 0, 0, 0, False), (None, 20, 20, 2, True), (1, 20, 20, 2, True), (1, 20, 20, 2, True)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontaminate.contamination(docs, empty).collect()} == {False}
    assert decontaminate.contamination(docs.limit(0), empty).count() == 0


def test_short_items_of_every_length(spark):
    words = [f"k{i}" for i in range(14)]
    items = [(n, " ".join(words[:n])) for n in range(1, 15)]
    docs = spark.createDataFrame([(n, "a " + " ".join(words[:n]) + " z") for n in range(15)], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    # From 13 words on a window of the longest item is enough.
    assert got == {n: (n, n if n < 13 else 14) for n in range(15)}


@pytest.mark.parametrize("size", [9, 12, 13, 14, 20])
def test_documents_shorter_than_a_window(spark, size):
    words = [f"k{i}" for i in range(20)]
    docs = spark.createDataFrame([(n, " ".join(words[:n])) for n in range(1, 14)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words[:size]))], "item_id long, text string")
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    db.register("benchmark", items.toPandas())
    assert differences(decontaminate.contamination(docs, items).drop("digest"), db, decontaminate.ORACLE) == []


def test_archives_round_trip(spark, tmp_path):
    html = ["<p>é</p>", None, "", "<p>é</p>", "x" * 200_000, "<p>é</p>", "y", "y"]
    ids = [5, 6, 7, 3, 9, 4, None, 2**60 + 1]
    urls = ["http://a/ b\r\nX: 1", None, "u", "", "u", "http://é/", "u", "u"]
    pages = spark.createDataFrame([(*r, "c") for r in zip(ids, urls, html, strict=True)], "page_id long, url string, html string, digest string").repartition(3)
    manifest = warc.write(pages, str(tmp_path / "a"), file_bytes=100)
    got = {r.page_id: r for r in warc.read(manifest).collect()}
    first = {3: "<p>é</p>", 6: "", 2**60 + 1: "y"}
    for page_id, text in zip(ids, html, strict=True):
        payload, r = (text or "").encode(), got[page_id]
        of = next((k for k, v in first.items() if v == (text or "")), page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if of == page_id else ("revisit", of))
        assert (bytes(r.payload) if r.payload is not None else None) == (payload if of == page_id else None)
    # The same table, dealt otherwise, gives the same files; nothing temporary is left.
    again = warc.write(pages.repartition(7), str(tmp_path / "b"), file_bytes=100)
    files = lambda m: {(r.file, r.records, r.bytes, r.sha256) for r in m.collect()}
    assert files(manifest) == files(again) and len(files(manifest)) > 2
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == sorted(f[0] for f in files(manifest))
    assert warc.read(warc.write(pages.limit(0), str(tmp_path / "c"))).count() == 0


def test_shards_follow_bytes_not_ids(spark, tmp_path):
    """4,000 pages, one of them with an id of 2**60, and 1,000 rows without id: shards stay equal, outlier or not."""
    rows = spark.range(4000).selectExpr("id as page_id", "concat('u', id) as url", "repeat(md5(cast(id as string)), 20) as html")
    outlier = spark.createDataFrame([(2**60, "u", "far")], "page_id long, url string, html string")
    some = spark.range(1000).selectExpr("cast(null as long) as page_id", "'u' as url", "repeat(sha1(cast(id as string)), 16) as html")
    sizes = []
    for i, table in enumerate((rows, rows.union(outlier), rows.union(some))):
        manifest = warc.write(table, str(tmp_path / str(i)), shard_bytes=200 * 1040)
        sizes.append({r.shard: r.records for r in manifest.collect()})
        assert sum(sizes[-1].values()) == table.count()
        assert max(sizes[-1].values()) <= 202
    assert sizes[0].items() <= {**sizes[1], 19: sizes[0][19]}.items() and len(sizes[2]) == 25
    again = warc.write(rows.union(some).repartition(5), str(tmp_path / "again"), shard_bytes=200 * 1040)
    files = lambda m: {(r.file, r.sha256) for r in m.collect()}
    assert files(manifest) == files(again)


def test_archive_query(spark):
    """The registered query over its whole table against plain digests."""
    rows = read_table(spark, SF, "pages").collect()
    digest = {r.page_id: base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode() for r in rows}
    first: dict = {}
    for k in sorted(digest):
        first.setdefault(digest[k], k)
    want = {(k, len((next(r.html for r in rows if r.page_id == k) or "").encode()), d, "response" if first[d] == k else "revisit", None if first[d] == k else first[d]) for k, d in digest.items()}
    got = queries.op3_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_damaged_archives_are_noticed():
    data = warc.member(warc.record(1, "u", "text", None, True))
    assert warc.parse(next(warc.records(io.BytesIO(data))))["payload"] == b"text"
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-20])))
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", "text", None, True).replace(b"text\r\n\r\n", b"tuxt\r\n\r\n"))


def verdict_of(host, path):
    best = ("", None)
    for r in queries.URL_RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and len(r.text) > len(best[0]):
            best = (r.text, r.verdict)
    return best


def test_url_rules_and_model(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Org/x", "http://org", "http://org/", "https://x.example.org/en/12?q#f", "http://notexample.org/es/a", "http://example.org/es/a", "a://b.com/de/#x", "http://x.com/DE/", "http://u.net?x=://org/", "http://COM/fr/\u00c9"]
    table = read_table(spark, SF, "pages").select("page_id", "url")
    pages = table.union(spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(urls)], "page_id long, url string")).withColumn("n", table.page_id * 0)
    got = url_filter.judge(pages, queries.URL_RULES).collect()
    assert len(got) == pages.count()
    for r in got:
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
        path = rest[len(host) :]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        rule, verdict = verdict_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule or None)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    ruled = [r for r in got if r.rule]
    assert np.mean([(r.score >= 0.5) == (r.verdict == "block") for r in ruled]) > 0.85
    plain = url_filter.judge(pages, []).collect()
    assert {r.verdict for r in plain} == {"allow"} and url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(pages.withColumn("host", pages.url), [])


def test_chat_trees(spark):
    said = "\\### Assistant: </turn> ok <turn>\n\\n"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < 3 else f"{c} {t}") for c in range(6) for t in range(2 + c)]
    rows += [(50, None, "user", None), (50, 1, None, "x"), (50, 1, "assistant", ""), (None, 0, "a\nb", "y"), (60, 0, "assistant", "é" * 50_000)]
    rows += [(70, t, "user", "deep") for t in range(100)] + [(71, t, "user", "deep") for t in range(90)]
    table = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, path string").repartition(4)
    got = {r.conv_id: r for r in chat_tree.format_conversations(table).collect()}
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat_tree.render(a, b)[0]) for _, a, b in turns) == sum(x.stop - x.start for x in r.attention)
    # Shared turns stand in the output once, in depth-first order with gapless places.
    steps = chat_tree.steps(table)
    trees = chat_tree.layout(steps)
    placed = trees.join(chat_tree.starts(trees), "shard").selectExpr("base + local_start as start", "length", "path", "parent", "position").toPandas().sort_values("start")
    assert len(placed) == steps.select("path").distinct().count() == placed.path.nunique()
    assert (placed.start.values == np.concatenate(([0], np.cumsum(placed.length)[:-1]))).all()
    assert chat_tree.format_conversations(table.limit(0)).count() == 0


def test_depth_first_order_of_deep_and_wide_trees(spark):
    """A hundred levels with branches at many of them, and 70,000 children of one system prompt."""
    deep = spark.range(40).selectExpr("id as conv_id", "explode(sequence(0, 99)) as turn", "'user' as role").selectExpr("conv_id", "turn", "role", "if(turn < 2 * conv_id, 'same', concat('of ', conv_id)) as text")
    wide = spark.range(70_000).selectExpr("id + 1000 as conv_id", "explode(array(0, 1)) as turn", "if(turn = 0, 'system', 'user') as role").selectExpr("conv_id", "turn", "role", "if(turn = 0, 'prompt', concat('child ', conv_id)) as text")
    trees = chat_tree.layout(chat_tree.steps(deep.union(wide)))
    placed = trees.join(chat_tree.starts(trees), "shard").selectExpr("base + local_start as start", "length", "path", "parent", "place").toPandas().sort_values("start")
    assert len(placed) == placed.path.nunique() == 70_001 + sum(100 - min(2 * c, 100) for c in range(40)) + 78
    # Depth-first: a node's parent is the last node one level up, so no subtree is interrupted.
    line: list[str] = []
    for path, parent, place in placed[["path", "parent", "place"]].itertuples(index=False):
        del line[place:]
        assert len(line) == place and (line[-1] if line else "") == parent
        line.append(path)


def test_chat_query(spark):
    """The registered query over its whole table, conversation -7 included, against plain formatting."""
    got = {r.conv_id: r for r in queries.op9_chat_tree(spark, SF).collect()}
    said = "\\### Assistant: </turn> ok"
    rows = read_table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()
    by: dict = {-7: [(0, "user", said), (1, "assistant", said)]}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        whole = "".join(f"{a}\n{b}\n" for _, a, b in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat_tree.render(a, b)[0]) for _, a, b in turns)


def test_rendering_is_reversible():
    rng = random.Random(6)
    for _ in range(2000):
        role, text = ("".join(rng.choice(["\\", "<turn>", "</turn>", "\n", "n", "é", "<"]) for _ in range(rng.randrange(8))) for _ in range(2))
        piece, a, b = chat_tree.render(role, text)
        assert chat_tree.parse(piece) == (role, text) and chat_tree.unescape(piece[a:b]) == text
        assert "<turn" not in piece[len(chat_tree.OPEN) :].replace("\\<turn", "")


def test_pipeline_stages(spark):
    rows = documents(n=30)
    columns = "doc_id text lang source n_chars".split()
    docs = frame(spark, rows).select(*columns).union(spark.createDataFrame([(None, None, None, None, None), (9, rows[3][1], "en", "s", 1)], ", ".join(SCHEMA.split(", ")[:5])))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert out.count() <= docs.count()


def test_pipeline_drops_what_the_operators_find(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    labels = read_table(spark, SF, "labels").toPandas()
    judged = queries.op2_quality(spark, SF).toPandas()
    assert not set(out.doc_id) & set(judged[judged.predicted == 0].doc_id)
    assert out.doc_id.is_unique and 0 < len(out) < 200
    good = pd.merge(labels[labels.quality == 1], judged, on="doc_id")
    assert (good.predicted == 1).mean() > 0.95


def test_a_rare_suffix_counts_among_the_labels(spark):
    rules = [url_filter.Rule("allow", "", "/"), url_filter.Rule("block", "rare.zz", "/")]
    urls = [(f"http://a.s{i}./{j}",) for i in range(2001) for j in range(2)] + [("http://rare.zz/",), ("http://open.zz/",)]
    judged = url_filter.judge(spark.createDataFrame(urls, "url string"), rules)
    assert judged.where("score is null").count() == 0 and judged.count() == len(urls)
