"""The queries against SQL, brute force, held-out labels and awkward tables."""

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from rasterjobs.llm import common, decontaminate, mixing, ngram_join, ogg, quality, queries, substring, tokenpack, toxicity, urlfilter, warc

SF1 = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])


def test_token_table_matches_the_library(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    got = {r.doc_id: r for r in queries.op10_token_pack(spark, sf).collect()}
    start = 0
    for r in common.table(spark, sf, "documents").orderBy("doc_id").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_token_table_finds_added_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    texts = ["one <|endoftext|> two<|endoftext|>", "plain words", "x!<|endoftext|>, y", None]
    got = {r.doc_id: r for r in tokenpack.token_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.tokenizer()).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)


def test_media_table_matches_the_payload(spark, sf):
    got = {r.doc_id: r for r in queries.op7_ogg_media(spark, sf).collect()}
    for r in common.table(spark, sf, "documents").collect():
        x = ogg.pad((r.text or "").encode())
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len((r.text or "").encode()), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]))


@pytest.mark.parametrize("sf,name,label,least", [(SF1, "op4_toxicity", "toxic", 0.9), (SF1, "op5_quality_mil", "quality", 0.9), ("/root/testdata/sf0.001", "op4_toxicity", "toxic", 0.65)])
def test_held_out_balanced_accuracy(sf, name, label, least, spark):
    got = queries.QUERIES[name](spark, sf).join(common.table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    right = [[r.predicted == r[label] for r in got if r[label] == y] for y in (0, 1)]
    assert all(len(x) >= 5 for x in right)
    assert sum(sum(x) / len(x) for x in right) / 2 >= least
    assert all(0 <= r.score <= 1 for r in got)


def test_classifiers_without_labels_or_documents(spark, sf):
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels").withColumnRenamed("toxic", "label")
    for part in (toxicity, quality):
        assert {r.score for r in part.score(docs, part.fit(docs, labels.limit(0))).collect()} == {0.5}
        assert part.score(docs.limit(0), part.fit(docs.limit(0), labels)).count() == 0
        one = {r.score for r in part.score(docs, part.fit(docs, labels.filter("label = 0"))).collect()}
        assert len(one) == 1 and one.pop() < 0.1


def _judge_brute(pages, rules):
    def parts(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        path = rest[cut:].split("?")[0].split("#")[0]
        return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path

    out = []
    for i, url in pages:
        host, path = parts(url)
        fit = [(len(h + p), len(p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out.append((i, host, path, *(max(fit)[2:] if fit else (None, None))))
    return out


def test_url_rules_against_brute_force(spark, sf):
    pages = common.table(spark, sf, "pages")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in queries.op3_url_filter(spark, sf).collect())
    want = sorted(_judge_brute([(r.page_id, r.url) for r in pages.collect()], queries.RULES))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[4] == w[4] for g, w in zip(got, want) if w[4])


def test_trust_and_distrust_spread_over_links(spark):
    def link(*hosts):
        return "".join(f'<a href="http://{h}/x">' for h in hosts)

    rows = [(1, "http://good.org/a", link("friend.net", "FRIEND.net")), (2, "http://friend.net/a", ""), (3, "http://spam.net/a", link("bad.example.org")), (4, "http://BAD.example.org/es/x", link("friend.net")), (5, "http://far.net", None), (6, "nonsense", "x"), (7, None, None), (8, "//h/p", ""), (9, "a://org/?q", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(df, queries.RULES).collect()}
    assert got == {1: ("org/", "allow"), 2: (None, "allow"), 3: (None, "block"), 4: ("example.org/es/", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("org/", "allow")}


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    n = 16
    rows = [(i, f"http://h{i}.net/a" if i else "http://bad.example.org/es/x", f'<a href="http://{f"h{i - 1}.net" if i > 1 else "bad.example.org"}/">' if i else "") for i in range(n)]
    got = {r.page_id: (r.verdict, r.distrust) for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES).collect()}
    want, score = {}, urlfilter.UNIT * 15 // 100
    for i in range(n):
        want[i], score = ("block", score), score * 85 // 100
    assert got == want


def _spread_brute(pages, rules):
    """Trust and distrust of hosts by a plain loop over all links, in whole numbers."""
    judged = _judge_brute([(i, u) for i, u, _ in pages], rules)
    links, seeds = {}, {}
    for (_, _, html), (_, host, _, _, action) in zip(pages, judged):
        for dst in set(re.findall(r'href="http://([^/"]+)', html)):
            if dst != host:
                links[host, dst] = links.get((host, dst), 0) + 1
        if host and action:
            seeds[host, action] = seeds.get((host, action), 0) + 1
    out = {}
    for action, way in (("allow", links), ("block", {(b, a): n for (a, b), n in links.items()})):
        sent = {}
        for (a, _), n in way.items():
            sent[a] = sent.get(a, 0) + n
        base = {h: n * urlfilter.UNIT * 15 // 100 for (h, x), n in seeds.items() if x == action}
        score = dict(base)
        while True:
            new = dict(base)
            for (a, b), n in way.items():
                if score.get(a):
                    new[b] = new.get(b, 0) + score[a] * n * 85 // (sent[a] * 100)
            if new == score:
                break
            score = new
        out[action] = score
    return [(i, r or None, a or ("block" if out["block"].get(h, 0) > out["allow"].get(h, 0) else "allow"), out["allow"].get(h, 0), out["block"].get(h, 0)) for i, h, _, r, a in judged]


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_on_random_graphs_against_a_plain_loop(spark, seed):
    import random

    rng = random.Random(seed)
    hosts = [f"h{i}.net" for i in range(14)] + ["good.org", "a.example.org", "x.com"]
    pages = []
    for i in range(60):
        path = rng.choice(["", "/", "/es/x", "/en/1", "/fr/y", "/de/z"])
        pages.append((i, f"http://{rng.choice(hosts)}{path}", "".join(f'<a href="http://{rng.choice(hosts)}/p">' for _ in range(rng.randrange(4)))))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r.page_id, r.rule, r.verdict, r.trust, r.distrust) for r in urlfilter.judge(df, queries.RULES).collect()}
    want = _spread_brute(pages, queries.RULES)
    assert got == set(want) and len({x[2] for x in want if x[1] is None}) == 2


ROWS = [(1, "a b c d e f g h i j k l m n", "s1"), (2, "a b c d e f g h i j k l m n", None), (3, None, "s1"), (4, "", "s2"), (5, "  \n\t", "s2"), (6, "x", "s1"), (6, "x", "s1"), (None, "x", None), (7, "long " * 60_000, "s2"), (8, "y" * 1_500_000, "s3"), (9, "A B C d e f g h i j k l m n o", "s1")]


def _awkward(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("n", "rep", "key", "id", "size", "taken", "a", "b", "rank", "items", "score", "part", "component_id", "h", "label"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("rows", [ROWS, ROWS[:0], ROWS[2:3]])
def test_awkward_documents(spark, rows):
    df, n = _awkward(spark, rows), len(rows)
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m"), (2, None), (3, "X"), (3, "X"), (None, "q")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (9, 0), (6, None), (None, 1)], "doc_id long, label int")
    got = {}
    for name, out in {
        "mix": queries.mix_documents(df), "hits": decontaminate.decontaminate(df, items), "links": ngram_join.similar_documents(df, n=3, num=90, den=100), "cut": substring.repeats(df),
        "tokens": tokenpack.token_table(df, queries.tokenizer()), "media": ogg.media_table(df), "toxic": toxicity.score(df, toxicity.fit(df, labels)), "quality": quality.score(df, quality.fit(df, labels)),
    }.items():
        got[name] = out.collect()
        assert len(got[name]) == n, name
    if n < 5:
        return
    hits = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got["hits"]}
    assert hits[1] == (14, 13, ["1"]) and hits[3] == (0, 0, []) and hits[6] == (1, 1, ["3"])
    links = {r.doc_id: (r.n_shingles, r.component_id) for r in got["links"]}
    assert links[2] == (12, 1) and links[3] == (0, 3) and links[6] == (1, 6) and links[9] == (13, 1)
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in got["cut"]}
    assert cut[1] == (14, 0) and cut[2] == (14, 14) and cut[7] == (60_000, 0) and cut[3] == (0, 0)
    assert sum(r.taken for r in got["mix"]) > 0 and all(r.taken <= 3 * r["size"] for r in got["mix"])
    assert next(r for r in got["tokens"] if r.doc_id is None).start == 0


def test_awkward_pages(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x"), (2, None, "x"), (2, "v", "x"), (None, "w", "x"), (5, "w", None), (6, "w", "")], "page_id long, url string, html string").withColumn("digest", F.lit(1))
    bundles = common.stage(warc.write_bundles(df), "b")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(bundles).collect())
    assert got == [(0, "revisit", 1, 1), (1, "response", None, 1), (2, "revisit", 1, 1), (2, "revisit", 1, 1), (5, "response", None, 0), (6, "revisit", 5, 0)]
    assert warc.read_records(warc.write_bundles(df.limit(0))).count() == 0
    warc.export(bundles, str(tmp_path))
    assert sum(len(warc.BundleReader(p.read_bytes()).sizes) for p in tmp_path.iterdir()) >= 1


def _components_brute(rows, n, num, den):
    """Component of each id; rows that share an id are one document."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets.setdefault(i, []).append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {i: lo if c == hi else c for i, c in label.items()}
    return label


def test_links_of_repeated_ids_and_regular_words(spark):
    from tests.llm.test_llm_units import thue_morse

    a = " ".join(f"w{i}" for i in range(100))
    rows = [(3, "only b"), (5, a), (5, "only b"), (9, a.replace("w50", "other", 1)), (12, "x y z"), (12, "p q r"), (13, "x y z"), (14, "p q r"), (20, "u v w"), (21, "v w u")]
    w, x = thue_morse("ab", 10)
    rows += [(30, f"{w} x y"), (31, f"{x} x y"), (32, f"{w} x y z"), (33, f"{w} x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in ngram_join.similar_documents(df, n=3, num=90, den=100).collect()}
    assert got == set(_components_brute(rows, 3, 90, 100).items())


def test_repeated_ids_with_blank_texts(spark, sf):
    import corpus_pipeline as p

    words = [f"w{i}" for i in range(200)]
    for blank in ("", None, " \n"):
        rows = [(1, " ".join(words)), (1, blank), (2, " ".join(words[:-1])), (3, blank), (3, "other words in this one")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {(r.doc_id, r.component_id) for r in ngram_join.similar_documents(df, n=3, num=90, den=100).collect()}
        assert got == {(1, 1), (2, 1), (3, 3)}
        kept = p.one_of_each_group(spark, df, sf).collect()
        assert sorted((r.doc_id, r.text or "") for r in kept) == sorted((i, t or "") for i, t in rows if i != 2)


def test_mix_tells_null_from_zero_and_keeps_columns(spark):
    rows = [(i, "a b c d", [None, "\0", "\0\0", "x"][i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    helpers = ["_words", "_slice", "_size", "_order", "_pattern", "_before", "_inside", "_tokens", "_parts", "_row", "_key", "row", "key", "sources"]
    for c in helpers:
        df = df.withColumn(c, F.lit(7))
    out = queries.mix_documents(df).collect()
    assert {(r.source, r.source_size) for r in out} == {(s, 40) for s in (None, "\0", "\0\0", "x")}
    assert all(r[c] == 7 for r in out for c in helpers)
    took = {s: (sum(r.taken for r in out if r.source == s), next(r.target for r in out if r.source == s)) for s in ("\0", "\0\0", "x", None)}
    assert all(abs(a - b) <= 1 for a, b in took.values()) and len({b for _, b in took.values()}) == 3


def test_a_host_of_very_many_labels(spark):
    rows = [(1, "http://" + "a." * 60_000 + "example.org/es/x", None), (2, "http://" + "." * 60_000 + "/fr/", None)]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES).collect()
    assert {(r.page_id, r.rule, r.verdict) for r in got} == {(1, "example.org/es/", "block"), (2, None, "allow")}


def test_clouds_of_near_copies_against_brute_force(spark):
    import random

    rng, rows = random.Random(7), []
    common_part = [f"c{i}" for i in range(30)]
    for cloud in range(6):
        base = [f"v{cloud}x{i}" for i in range(rng.choice([8, 40, 150]))]
        for _ in range(rng.choice([2, 5, 25])):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 20)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(50)}"
            rows.append((len(rows), " ".join(words + (common_part if cloud % 2 else []))))
    for i in range(40):  # nothing in common but a passage
        rows.append((len(rows), " ".join([f"s{i}x{j}" for j in range(60)] + common_part)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, num in ((5, 80), (3, 90)):
        got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(df, n=n, num=num, den=100).collect()}
        assert got == _components_brute(rows, n, num, 100)


def test_mix_of_overlapping_sources(spark):
    rows = [(i, 10, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b", None]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, size long, src array<string>")
    out = mixing.mix(df, sources="src", size="size", key="id", weights=mixing.cycle_weights, total=600).collect()
    want = out[0].targets
    took = {s: sum(r.taken.get(s, 0) for r in out) for s in ("a", "b", "\0")}
    full = {k: v for r in out for k, v in r.targets.items()}
    assert want and all(abs(took[s] - full[s]) <= 1 for s in took)
    assert all(sum(r.taken.values()) <= 30 for r in out)
    with_no_source = mixing.mix(df.withColumn("src", F.lit(None).cast("array<string>")), sources="src", size="size", key="id", weights=mixing.cycle_weights)
    assert {len(r.taken) for r in with_no_source.collect()} == {0}


def _hits_brute(text, items, n=13):
    w = decontaminate.item_words((text or "").encode())
    hit, names = set(), set()
    for item, t in items:
        x = decontaminate.item_words((t or "").encode())
        size = min(n, len(x))
        windows = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                names.add(item)
    return len(w), len(hit), sorted(str(x) for x in names if x is not None)


@pytest.mark.parametrize("prints", [decontaminate.MOST_PRINTS, 0])
def test_a_shared_fingerprint_makes_no_pairs(spark, monkeypatch, prints):
    """Many documents and items share seven words: only documents that hold a window of an item get windows of it."""
    monkeypatch.setattr(decontaminate, "MOST_PRINTS", prints)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", prints)
    tables = {}
    monkeypatch.setattr(decontaminate, "stage", lambda df, name: tables.setdefault(name, common.stage(df, name)))
    rng, line = random.Random(11), "the seven words that all texts share"
    items = [(i, " ".join([f"i{i}x{j}" for j in range(15)] + [line] + [f"i{i}y{j}" for j in range(15)])) for i in range(40)]
    items += [(50, "short item"), (51, "Short, ITEM"), (52, None), (53, " .. "), (None, items[3][1]), (54, items[4][1])]
    docs = [(i, " ".join([f"d{i}x{j}" for j in range(12)] + [line] + [f"d{i}y{j}" for j in range(12)])) for i in range(60)]
    for i in (3, 4, 5):
        words = items[i][1].split()
        for size in (12, 13, 20, len(words)):
            at = rng.randrange(len(words) - size + 1)
            docs.append((100 + len(docs), " ".join(["before"] * 3 + words[at : at + size] + ["after"] * 3)))
    docs += [(7, "a short item, and a SHORT item"), (7, items[5][1]), (None, items[3][1]), (None, None), (8, "")]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    key = lambda r: (r[0] or -1, r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=key) == sorted(((i, *_hits_brute(t, items)) for i, t in docs), key=key)
    assert tables["item-windows"].count() < 100
    if not prints:
        assert tables["candidates"].filter("cid < 60 and cid != 7").count() == 0


def test_many_sources_take_a_step_each(spark):
    df = spark.range(200_000).selectExpr("id", "id % 7 size", "array(cast(id as string)) src")
    began = time.time()
    out = mixing.mix(df, sources="src", size="size", key="id", weights=mixing.cycle_weights)
    row = out.selectExpr("count(*) n", "sum(taken[src[0]]) took", "sum(size) size", "max(taken[src[0]] - 3 * size) over_size").first()
    assert row.n == 200_000 and row.over_size <= 0 and abs(row.took - row["size"]) < 100_000 and time.time() - began < 60


def test_joins_without_the_bitmap_or_broadcasts(spark, same, monkeypatch):
    monkeypatch.setattr(common.Repeated.__init__, "__defaults__", (1,))
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    same(queries.QUERIES["op9_substring_dedup"], queries.OP9)
    same(queries.QUERIES["op8_ngram_join"], queries.OP8)


def _repeats_brute(rows, n):
    """Spans to remove from each row, judged on the input."""
    first = {}
    words = [(i, (t or "").split()) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - n + 1):
            g = tuple(w[j : j + n])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = {x for j in range(len(w) - n + 1) if first[tuple(w[j : j + n])] < i for x in range(j, j + n)}
        starts = sorted(x for x in gone if x - 1 not in gone)
        out.append((i, len(w), [(a, next(b for b in range(a, len(w) + 1) if b not in gone)) for a in starts], " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("hot,n,k", [(None, 13, 7), (2, 13, 7), (2, 5, 2)])
def test_repeats_against_brute_force(spark, monkeypatch, hot, n, k):
    import random

    from tests.llm.test_llm_units import thue_morse

    if hot:  # every repeated anchor is split
        monkeypatch.setattr(common, "HOT_KEY", hot)
    rng, rows = random.Random(n + (hot or 0)), []
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.choice([12, 13, 14, 30, 70]))) for _ in range(6)]
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"u{i}x{j}" for j in range(rng.randrange(12))) for _ in range(rng.randrange(5))]
        if rng.random() < 0.3:  # few different words, so that windows hold equal anchors
            parts.append(" ".join(rng.choice("xy") for _ in range(rng.randrange(60))))
        rows.append((rng.choice([i, i, i, max(0, i - 1)]), "\n".join(parts)))
    same, other = " ".join(f"t{i}" for i in range(12)), thue_morse("ab", 10)
    rows += [(500, f"{same} {other[0]}"), (501, f"{same} {other[1]}"), (502, None), (503, "")]
    rows += [(600 + i, f"{passages[0]} {passages[4]} e{i}") for i in range(40)]
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string"), n=n, k=k).collect()
    assert sorted((r.doc_id, r.n_words, [(s.start, s.end) for s in r.spans], r.kept_text) for r in got) == sorted(_repeats_brute(rows, n))


def test_pipeline_stages_on_awkward_documents(spark, sf):
    import corpus_pipeline as p

    item = common.table(spark, sf, "benchmark").filter("length(text) > 200").first().text
    bad = toxicity.Model(["badword"], [], [9.0, 0, 0, 0, 0, 0, -3.0])
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, "a badword b", "s"), (None, "a badword b", "s"), (2, item, "s"), (None, item, "t"), (3, long, "s"), (None, long, None), (4, long + " x", "t"), (5, "p q", "s"), (5, "p q", "s"), (5, "r s", "t"), (None, "u v", "s"), (6, None, "s"), (7, "", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("xx"))
    for c in ("n_chars", "size", "taken", "target", "source_size", "copy", "_words", "_id", "_hash", "score", "key"):
        docs = docs.withColumn(c, F.lit("mine"))
    columns = docs.columns

    def ids(df):
        assert df.columns == columns and df.filter("size <> 'mine' or copy <> 'mine' or _words <> 'mine'").count() == 0
        return sorted((r.doc_id or 0, r.text or "") for r in df.collect())

    every = sorted((i or 0, t or "") for i, t, _ in rows)
    fit, queries.toxicity_model = queries.toxicity_model, lambda *_: bad
    try:
        assert ids(p.reject_toxic(spark, docs, sf)) == [x for x in every if "badword" not in x[1]]
    finally:
        queries.toxicity_model = fit
    kept = ids(p.one_of_each_group(spark, docs, sf))
    assert kept == sorted(x for x in every if x not in [(0, "a badword b"), (0, item), (0, long), (4, long + " x")])
    assert ids(p.decontaminated(spark, docs, sf)) == [x for x in every if x[1] != item]
    mixed = ids(p.mixed(spark, docs, sf))
    assert set(mixed) <= {x for x in every if x[1]} and all(mixed.count(x) <= 3 * every.count(x) for x in set(mixed))
    assert p.tokens(spark, docs, sf).count() == len(rows)
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = common.table(spark, sf, "documents")
    kept = [docs]
    for name, f in p.STAGES:
        kept.append(common.stage(f(spark, kept[-1], sf), name))
    assert all(k.columns == docs.columns for k in kept[:-1])
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] >= ids[4] == ids[5]
    assert kept[4].count() == kept[5].count()
    groups = ngram_join.similar_documents(kept[1], n=5, num=80, den=100).collect()
    assert ids[2] == {r.doc_id for r in groups if r.doc_id == r.component_id}
    toxic = {r.doc_id for r in common.table(spark, sf, "labels").filter("toxic = 1").collect()}
    assert len(ids[1] & toxic) < len(toxic) / 2 and len(ids[0]) - len(ids[1]) < 60
