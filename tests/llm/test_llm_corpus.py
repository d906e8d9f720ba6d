"""Site styles, language model, archives, tiling, near duplicates and the pipeline on small frames."""

import collections
import hashlib
import math
import random
import time
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from clickpath.llm import bag_minhash, bloom_lm, oracles, queries, site_style, string_tiling, warc_zstd

SF = "/root/testdata/sf0.001"


def page(i, body, extra=""):
    return (f"<html><head><title>t</title><script>var t='</p>';</script></head><body><nav><a href=/>Home</a></nav>"
            f"{extra}<article><h1>Title {i}</h1>{body}</article><div class='comments'><p>Nice</div>"
            f"<footer>&copy; x</footer></body></html>")


def test_site_style_cuts_what_repeats(spark):
    rows = [(i, f"http://a.org/{i}", f"<body><div><p>One {i} of its kind &amp;\n more</p><p>Two {i}</p></div>"
             "<section><p>Call us today</p><p>Opening hours</p></section></body>") for i in range(20)]
    rows += [(100 + i, "http://b.org/", page(1, "<p>Copied<br>text<p>Second")) for i in range(12)]
    rows += [(200, None, None), (201, "http://c.org", ""), (202, "http://c.org", page(2, "<p>Cut &am")[:-60])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in site_style.extract(frame, ["page_id", "url"]).collect()}
    assert len(found) == len(rows)
    assert all(found[i].text == f"One {i} of its kind & more\n\nTwo {i}" for i in range(20))
    assert all(found[100 + i].text == "Title 1\n\nCopied text\n\nSecond" for i in range(12))
    assert [found[i].n_chars for i in (200, 201)] == [0, 0]
    assert found[202].text.startswith("Title 2\n\nCut")
    assert site_style.extract(frame.limit(0), ["page_id", "url"]).count() == 0


def test_language_model_by_dictionaries(spark):
    """Against counts in dictionaries; the filter may only take some bigrams for more frequent than they are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(5000, None), (5001, ""), (None, "the the"), (None, "the the")], docs.schema)
    docs = docs.union(more)
    found = bloom_lm.scores(docs, block_tokens=5_000, shard_tokens=4_000).collect()
    again = bloom_lm.scores(docs, block_tokens=9_000, shard_tokens=4_000).collect()
    order = lambda r: (r.doc_id is None, r.doc_id or 0)
    found, again = sorted(found, key=order), sorted(again, key=order)
    assert [r.score for r in found] == pytest.approx([r.score for r in again])
    counts, pairs, texts = collections.Counter(), collections.Counter(), collections.defaultdict(str)
    for doc_id, text in docs.collect():
        texts[doc_id] = text or ""
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2:
            own = (text or "").encode().lower().split() + [b" "]
            counts.update(own)
            pairs.update(zip([b" ", *own], own))
    total, surplus = sum(counts.values()), []
    for r in found:
        tokens = texts[r.doc_id].encode().lower().split() + [b" "]
        base = sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in tokens)
        assert r.base_score == pytest.approx(base) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(counts[t] > 0 for t in tokens))
        exact = raised = 0.0
        for history, t in zip([b" ", *tokens], tokens):
            chances = []
            for more in (0, 1):  # the level, and one more
                n = pairs[history, t]
                level = n.bit_length() + more
                mean = (2 ** (level - 1) + 2 ** level - 1) / 2 if level else 0
                c = min(mean, counts[history], counts[t])
                chances.append((c + 100 * (counts[t] + 1) / (total + len(counts) + 1)) / (counts[history] + 100))
            exact += math.log10(chances[0])
            raised += math.log10(chances[1])
        # 1.4 % of probes find what is not there
        assert exact - 1e-6 <= r.score <= exact + 0.1 * (raised - exact) + 2
        surplus.append((r.score - exact) / len(tokens))
    assert 0 <= np.mean(surplus) < 0.02
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert bloom_lm.scores(docs.limit(0)).collect() == []


def test_filter_never_underestimates():
    draw = np.random.default_rng(2)
    hashes = draw.integers(0, 1 << 40, 20_000).astype(np.uint64)
    counts = draw.integers(1, 50, 20_000)
    packed = bloom_lm.filled(hashes[:10_000], counts[:10_000])
    assert (bloom_lm.probed(packed, hashes[:10_000]) >= bloom_lm.level(counts[:10_000])).all()
    assert (bloom_lm.probed(packed, hashes[10_000:]) > 0).mean() < 0.04


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://a.org/{i}\r\nX: y", f"<p>page {i % 30} {'lorem ipsum ' * 40}</p>\r\n\r\n") for i in range(200)]
    rows += [(None, None, None), (500, "u", None), (501, "u", ""), (501, "u", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc_zstd.write(frame, archive_bytes=20_000).cache()
    found = warc_zstd.read(archives).collect()
    assert len(found) == len(rows)
    latest = {}
    for i, _, html in rows:
        latest[html or ""] = max(latest.get(html or "", -1), -1 if i is None else i)
    for r in found:
        html = next(h or "" for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(html.encode())
        first = latest[html]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
    warc_zstd.export(archives, str(tmp_path))
    files = list(tmp_path.iterdir())
    assert sum(len(list(warc_zstd.records(f.read_bytes()))) for f in files) == len(rows)
    assert any(f.read_bytes()[:4] == b"\x5d\x2a\x4d\x18" for f in files)
    assert warc_zstd.read(warc_zstd.write(frame.limit(0))).collect() == []


def brute_tiles(doc, item, size):
    marked_d, marked_i, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while (i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]
                       and i + n not in marked_d and j + n not in marked_i):
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < size:
            return total
        marked_d.update(range(i, i + n))
        marked_i.update(range(j, j + n))
        total += n


@pytest.mark.parametrize("seed", range(40))
def test_tiles_by_brute_force(seed):
    draw = random.Random(seed)
    doc, item = ([draw.choice("abcd") for _ in range(draw.randint(0, 40))] for _ in range(2))
    seeds = [string_tiling._seeds(" ".join(x), {}, 3) for x in (doc, item)]
    found = string_tiling.tiles(np.arange(len(seeds[0])), seeds[0].view(np.int64), seeds[1].view(np.int64), 3)
    assert sum(t[2] for t in found) == brute_tiles(doc, item, 3)


def test_reordered_leaks_are_found(spark):
    words = [f"w{i}" for i in range(40)]
    item, turned = " ".join(words), " ".join(words[20:] + ["between"] + words[:20])
    rows = [(1, f"before {turned} after"), (2, "nothing of it " * 9), (3, None), (3, ""), (None, item),
            (4, item), (4, item), (5, " ".join(words[:12]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (None, item)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in string_tiling.contaminated(docs, items).collect()}
    assert set(found) == {(1, 7), (4, 7)}
    assert (found[1, 7].coverage, found[1, 7].n_tiles, found[1, 7].longest) == (1.0, 2, 20)
    assert string_tiling.contaminated(docs.limit(0), items).collect() == []
    assert string_tiling.contaminated(docs, items.limit(0)).collect() == []


def test_signatures_estimate_weighted_jaccard():
    draw = np.random.default_rng(1)
    hashes = draw.integers(0, 2 ** 63, 200).astype(np.uint64)
    a = draw.integers(1, 20, 200)
    b = np.where(draw.random(200) < 0.7, a, draw.integers(1, 20, 200))
    same = []
    for turn in range(30):
        one, two = bag_minhash.signatures([(h := bag_minhash.mix64(hashes + np.uint64(turn)), a), (h, b)])
        same.append((one == two).mean())
    assert np.mean(same) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def classes_by_brute_force(rows):
    known, texts = {}, {}
    for i, text in sorted(rows, key=lambda r: hashlib.md5((r[1] or "").encode()).digest()):
        texts.setdefault(i, text or "")
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if texts[i] == texts[j] or texts[i] and texts[j] and bag_minhash.overlap(texts[i], texts[j], known) >= 0.8:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_near_duplicates_by_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for group in range(12):
        base = [f"g{group}w{draw.randint(0, 60)}" for _ in range(80)]
        for copy in range(group + 1):
            words = list(base)
            for _ in range(draw.randint(0, 4)):
                words[draw.randrange(80)] = f"new{draw.random()}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "one two"), (1004, "a a a a a a a " * 900)]
    frame = spark.createDataFrame(rows + [(1003, "one two")], "doc_id long, text string").repartition(5)
    found = bag_minhash.near_duplicates(frame).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.class_id for r in found} == classes_by_brute_force(rows)
    assert {r.doc_id for r in found if r.n_rows > 1} == {1003}
    assert bag_minhash.near_duplicates(frame.limit(0)).collect() == []


def edited(draw, words, places, edits):
    words = list(words)
    for place in draw.sample(places, edits):
        words[place] = f"new{draw.random()}"
    return " ".join(words)


def test_stars_chains_and_clusters_keep_their_links(spark):
    """Copies that are like their original but not like each other, sliding windows, and both mixed."""
    draw = random.Random(11)
    centre = [f"w{i}" for i in range(100)]
    texts = [" ".join(centre)] + [edited(draw, centre, range(8, 92), 2) for _ in range(300)]
    texts += [" ".join(f"c{i + shift}" for i in range(100)) for shift in range(0, 240, 4)]
    for group in range(30):
        base = [f"g{group}_{draw.randrange(500)}" for _ in range(draw.randrange(30, 200))]
        texts += [edited(draw, base, range(len(base)), draw.randrange(4)) for _ in range(draw.randrange(1, 12))]
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    # two rows of one doc_id, in either order: the least text by hash speaks
    rows = [*zip(ids, texts), (5000, texts[0]), (5000, "some other text here that is alone"), (None, texts[0])]
    want = classes_by_brute_force([r for r in rows if r[0] is not None])
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "doc_id long, text string")
        assert {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(frame).collect()} == want
    assert len({want[i] for i in ids[:301]}) == 1


def test_blocks_of_a_bucket_meet_once(spark):
    """Small blocks: a large class beside strays, all pairs between classes and none inside."""
    label = {i: 0 if i < 60 else i for i in range(90)}
    labels = spark.createDataFrame(list(label.items()), "id long, cls long")
    members = labels.selectExpr("7L AS bucket", "id")
    groups = {}
    for r in bag_minhash.in_groups(members, labels, block=8).collect():
        groups.setdefault((r.first, r.second), ([], []))[r.side].append(r.id)
    met = collections.Counter()
    for left, right in groups.values():
        assert len(left) <= 24 and len(right) <= 24
        pairs = [(a, b) for a in left for b in right] if right else [(a, b) for a in left for b in left if a < b]
        met.update((min(p), max(p)) for p in pairs if label[p[0]] != label[p[1]])
    assert set(met.values()) == {1}
    assert set(met) == {(a, b) for a in range(90) for b in range(a + 1, 90) if label[a] != label[b]}
    one_class = spark.createDataFrame([(i, 0) for i in range(90)], "id long, cls long")
    assert bag_minhash.in_groups(members, one_class, block=8).count() == 0


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(oracles.SQL[name])
    found = queries.QUERIES[name](spark, SF)
    place = [want.columns.index(c) for c in found.columns]
    rows = sorted(tuple(repr(row[i]) for i in place) for row in want.fetchall())
    assert sorted(tuple(map(repr, r)) for r in found.collect()) == rows


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        if name != "mixing":
            assert after.columns == docs.columns
        counts.append(after.count())
        before = after
    assert counts[0] < docs.count() and counts[1] <= counts[0] and counts[3] == counts[2] == counts[4]
    leaked = string_tiling.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert before.join(leaked, "doc_id").count() == 0


def test_pages_as_browsers_read_them():
    def text(page):
        return site_style.blocks_of(site_style.parse(page))

    deep = "<div>" * 45 + "<nav>menu</nav><div class='advert'>ad</div>" + "</div>" * 45
    assert text(f"<article><p>First</p>{deep}<p>Last</p></article>") == ["First", "Last"]
    assert text("<html><head><title>T</title><p>para</p></html>") == ["para"]
    assert text("<head><title>T</title>plain<p>q") == ["plain", "q"]
    cell = "<div><article><p>a</p><table><tr><td>x</div>y</td></tr></table><p>b</p></article></div>"
    assert text(cell) == ["a", "xy", "b"]
    assert text("<div>" * 50_000 + "deep</i>" + "</div>" * 50_000) == ["deep"]


@pytest.mark.parametrize("page", ['<a b"' * 100_000, '<a b"' * 100_000 + ">x", "<" * 300_000, "<p>" * 100_000])
def test_hostile_pages_are_read_in_linear_time(page):
    begin = time.perf_counter()
    list(site_style.style_nodes(site_style.parse(page)))
    assert time.perf_counter() - begin < 10
