"""The ten operators against brute force on small stored tables with nulls, empty and long texts, ties, repeated rows and
clashing column names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash

from pyspark.sql import functions as F

from fieldbook.llm import ann, decontam, htmltext, langid, mixing, sharding, simhash, suffixes, tokencount, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, fp string, size int, shard string, slot int, id int, label double"
WORDS = "the of and to in is was on by with at from or an be this that it as are der die und ein ist nicht mit von le la les des est une que dans pour".split()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)

    def prose(n: int) -> str:
        return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))

    texts: list[str | None] = [prose(rng.choice([3, 30, 80, 200])) for _ in range(60)]
    texts += [texts[0], texts[0], texts[5] + " tail", "x " + texts[5], None, None, "", "  \n\t ", "One", "one TWO three", "été " * 60, prose(6000), "a " * 400]
    passage = prose(70)
    texts += [prose(40) + " " + passage + " " + prose(30), passage, prose(20) + " " + passage + prose(20)]
    rows = [(k, t, ["en", "de", None][k % 3], ["s", "b", "é", None, "big", "big", "big"][k % 7], len(t or ""), k, "z", 1, "q", 2, 3, 0.5) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "no id here", "en", "s", 1, 1, "z", 1, "q", 2, 3, 0.5), (None, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


# 1 -------------------------------------------------------------------------------------------------------------------


def test_repeated_passages_match_brute_force(docs, empty):
    rows = corpus()
    seen = Counter(" ".join(w[i : i + 50]) for w in (words(r[1]) for r in rows) for i in range(len(w) - 49))

    def covered(text):
        w = words(text)
        hit = [False] * len(w)
        for i in range(len(w) - 49):
            if seen[" ".join(w[i : i + 50])] > 1:
                hit[i : i + 50] = [True] * 50
        return hit

    got = sorted(((r.id if r.id is not None else -1), r.n_words, r.n_repeated) for r in suffixes.repeated_passages(docs).collect())
    assert got == sorted((r[0] if r[0] is not None else -1, len(words(r[1])), sum(covered(r[1]))) for r in rows)
    assert any(0 < n < m for _, m, n in got)
    assert suffixes.repeated_passages(empty).count() == 0


def test_cut_repeats_keeps_each_passage_once(docs):
    out = suffixes.cut_repeats(docs)
    assert out.columns == docs.columns
    rows, left = corpus(), [" ".join(words(r.text)) for r in out.collect()]
    assert sum(" ".join(words(rows[-4 - 1][1])) in t for t in left) == 1  # the passage that three documents share
    assert sum(" ".join(words(rows[5][1])) in t for t in left) == 1
    assert max(t.count("a ") for t in left) in range(49, 60)  # of 400 equal words the first passage
    alone = [" ".join(words(r[1])) for r in rows if len(words(r[1])) < 50]
    assert all(t in left for t in alone)


# 2 -------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(k) for k in range(len(prints))]


@pytest.mark.parametrize("tile", [simhash.TILE, 4])
def test_simhash_matches_brute_force(docs, tile):
    rows = corpus()
    prints = [brute_fingerprint(r[1]) for r in rows]
    of = brute_components(prints)
    smallest = {c: min((rows[k][0] for k in range(len(rows)) if of[k] == c and rows[k][0] is not None), default=None) for c in set(of)}
    found, groups = simhash.near_duplicates(docs, tile=tile)
    got = [(r.id, r.fp % (1 << 64), r.keep.id) for r in found.join(groups, "fp").collect()]
    assert sorted(map(str, got)) == sorted(str((r[0], p, smallest[c])) for r, p, c in zip(rows, prints, of, strict=True))


def test_tiles_lose_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 5, np.uint64)
    fp = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for b in base]))
    links = {(int(a), int(b)) for a in fp for b in fp if a != b and int(a ^ b).bit_count() <= 4}
    a, b = simhash.tile_links(fp[::2], fp[1::2])
    ends = simhash.run_links(np.zeros(len(fp), np.int64), fp)
    assert all((int(x), int(y)) in links or int(x ^ y).bit_count() > 4 for x, y in zip(a, b, strict=True))
    of = brute_components([int(x) for x in fp])
    assert len(ends[0]) == len(fp) - len(set(of))


def test_drop_near_duplicates_keeps_one_of_each(docs, empty):
    rows = corpus()
    of = brute_components([brute_fingerprint(r[1]) for r in rows])
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert len(kept) == len(set(of))
    firsts = {c: min((rows[k][0] is None, rows[k][0] or 0) for k in range(len(rows)) if of[k] == c) for c in of}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(firsts.values())
    assert simhash.drop_near_duplicates(empty).count() == 0


# 3 -------------------------------------------------------------------------------------------------------------------


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, tests):
    w, hit, found = plain(text), set(), set()
    for item, t in tests:
        iw = plain(t)
        size = min(10, len(iw))
        windows = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if iw else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(w), len(hit), sorted(str(i) for i in found if i is not None)


def leaked_items():
    rows = corpus()
    return [(1, " ".join(rows[2][1].split()[5:30]), "a"), (22, rows[7][1], "b"), (3, "ONE, two; three!", "c"), (3, "One", None), (None, rows[9][1], None), (5, None, None), (6, " .. ", None), (7, rows[7][1], "d"), (8, "a a a a a a a a a a a", "")]


@pytest.mark.parametrize("shard_bytes", [decontam.SHARD_BYTES, 300])
def test_decontamination_matches_brute_force(spark, docs, shard_bytes):
    tests = leaked_items()
    found, (n, spans, hit) = decontam.find_spans(docs, items(spark, tests), shard_bytes=shard_bytes)
    got = sorted(str((r.doc_id, r[n], sum(s.end - s.start for s in r[spans]), r[hit])) for r in found.collect())
    assert got == sorted(str((r[0], *brute_hits(r[1], [t[:2] for t in tests]))) for r in corpus())


def test_automaton_tracks_longest_matches():
    auto = decontam.Automaton([("a", [b"x", b"y", b"x", b"z"]), ("b", [b"y", b"x", b"y"])])
    code = [auto.number.get(w, 0) for w in (b"x", b"y", b"x", b"y", b"q", b"x", b"z")]
    assert auto.longest(code) == [1, 2, 3, 3, 0, 1, 2]


def test_decontaminate_cuts_spans_and_leaves_clean_documents(spark, docs, empty):
    tests = [t for t in leaked_items() if t[1] and len(plain(t[1])) >= 10]
    out = decontam.decontaminate(docs, items(spark, tests), n_chars="n_chars")
    assert out.columns == docs.columns
    kept = out.collect()
    assert all(brute_hits(r.text, [t[:2] for t in tests])[1] == 0 for r in kept)
    clean = [r for r in corpus() if brute_hits(r[1], [t[:2] for t in tests])[1] == 0]
    assert sorted(str((r[0], r[1])) for r in clean) == sorted(str((r.doc_id, r.text)) for r in kept if (r.doc_id, r.text) in {(c[0], c[1]) for c in clean})
    assert decontam.decontaminate(docs, items(spark, [])).count() == len(corpus())
    assert decontam.decontaminate(empty, items(spark, tests)).count() == 0


def test_cut_words():
    assert decontam.cut_words("A b, c! d e", [(1, 3)]) == "A\n! d e"
    assert decontam.cut_words(None, []) is None


# 4 -------------------------------------------------------------------------------------------------------------------


def test_neighbours_recall_and_edge_cases(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 24))
    x = np.concatenate([c + 0.7 * rng.standard_normal((120, 24)) for c in centres])
    x[100:160] = x[100]  # ties
    rows = [(k, v.tolist(), 0, 1) for k, v in enumerate(x)]
    rows += [(5000, None, 0, 0), (5050, [0.0] * 24, 0, 0), (5100, [float("nan")] * 24, 0, 0), (5150, [1.0] * 3, 0, 0), (5200, [None] * 24, 0, 0), (None, x[0].tolist(), 0, 0), (5250, [float("inf")] * 24, 0, 0), (0, x[0].tolist(), 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, job int, row int")
    got = {}
    for r in ann.search(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {k for k in range(len(x)) if k % 50 == 0}
    assert got[0][0][0] == 0  # the repeated row of the query itself
    ids = np.r_[np.arange(len(x)), 0]
    full = np.concatenate([x, x[:1]])
    found = total = 0
    for q, near in got.items():
        score = ann.cosine(x[q], full)
        score[q] = -2
        best = np.lexsort((ids, -score))[:5]
        total += 5
        found += len({int(ids[b]) for b in best} & {v for v, _ in near})
        if q:
            assert len(near) == 5
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
    assert found / total >= 0.9
    assert [v for v, _ in got[100]] == [101, 102, 103, 104, 105]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(few, F.col("id") % 50 == 0).collect()] == [(0, 1, 1)]
    assert ann.search(few.limit(0), F.col("id") % 50 == 0).count() == 0


# 5 -------------------------------------------------------------------------------------------------------------------


def test_recount_equals_full_encoding(docs, empty):
    with open(tokencount.VOCABULARY) as file:
        encoding = tiktoken.Encoding("t", pat_str=tokencount.PATTERN, mergeable_ranks=tokencount.read_ranks(file.readlines()), special_tokens={})
    texts = {r[0]: r[1] for r in corpus() if r[0] is not None}
    for r in tokencount.recount(docs, tokencount.derived_edits(docs)).collect():
        if r.id is not None:
            assert r.n_tokens == len(encoding.encode_ordinary(texts[r.id] or ""))
        assert r.n_tokens_after == len(encoding.encode_ordinary(r.text or "")) and r.n_edits == tokencount.EDITS
        if r.n_encoded > 2000:
            assert r.n_encoded_again < r.n_encoded / 4
    assert tokencount.recount(empty, tokencount.derived_edits(empty)).count() == 0
    assert {r.n_tokens == r.n_tokens_after for r in tokencount.recount(docs, F.lit(None)).collect()} == {True}


def test_tree_edits_at_borders():
    with open(tokencount.VOCABULARY) as file:
        counter = tokencount.Counter(tokencount.read_ranks(file.readlines()))
    rng = random.Random(2)
    parts = ["'ll ", "  \n\n ", " 12 3", "don't we'", "é", "\t \t", "x", "", "   ", "'", "l", " "]
    for _ in range(30):
        tree = tokencount.Tree(counter, "".join(rng.choice(parts) for _ in range(rng.choice([0, 5, 300]))))
        for _ in range(12):
            start, gone, new = rng.randrange(len(tree.text) + 2), rng.choice([0, 1, 9, 200]), rng.choice(parts)
            expected = tree.text[:start] + new + tree.text[start + gone :]
            tree.edit(start, gone, new)
            assert tree.text == expected and tree.total == len(counter.encoding.encode_ordinary(expected))


# 6 -------------------------------------------------------------------------------------------------------------------


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_url_filter_matches_brute_force(spark):
    rules = (*urlfilter.QUERY_RULES, *(urlfilter.Rule("block", f"h{k}.example.org", f"/a{k}/") for k in range(40)))
    urls = [None, "", "x", "http://", "https://NET/a", "http://net", "http://a.net/en/", "ftp://u.example.net/en/x?q", "http://example.net/enx", "http://xexample.net/en/", "http://a.org/fr/#f", "http://b.org/?x=.net/", "http://a.com/.net/", "a?b=http://c.net/x",
            "http://EXAMPLE.com/de/" + "y" * 5000, "http://b.example.com/DE/", "http://h7.example.org/a7/", "http://z.h39.example.org/a39/q", "http://é.net/", "http://\n.net/\n/"]
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate([*urls, urls[4]])], "page_id long, url string, host string, rule string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, rules).collect()}
    assert got == {k: brute_verdict(u, rules) for k, u in enumerate([*urls, urls[4]])}
    assert urlfilter.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in urlfilter.judge(df, ()).collect()} == {"allow"}


def test_shift_and_stars():
    globs = ["a*c", "*b", "abc*", "*", "ab"]
    automaton = urlfilter.ShiftAnd([[None if c == "*" else ord(c) for c in g] for g in globs])
    strings = ["abc", "ac", "b", "", "ab", "aXXc", "abcd", "a" * 700 + "c"]
    got = automaton.matches([np.frombuffer(s.encode(), np.uint8).astype(np.int16) for s in strings])
    assert got.tolist() == [[bool(re.fullmatch(g.replace("*", ".*"), s)) for g in globs] for s in strings]


# 7 -------------------------------------------------------------------------------------------------------------------


def test_mix_near_targets(docs, empty):
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for r in corpus():
        sizes[r[3]] += len(words(r[1]))
    total = sum(sizes.values())
    assert sum(r.size for r in rows) == total
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, budget = {}, set(order), 1.5 * total
    while True:
        level = budget / sum(weight[s] for s in left)
        above = [s for s in left if level * weight[s] > 2 * sizes[s]]
        if not above:
            target |= {s: level * weight[s] for s in left}
            break
        for s in above:
            target[s] = 2 * sizes[s]
            budget -= target[s]
            left.discard(s)
    assert sorted({(r.source_size, round(r.target, 6)) for r in rows}) == sorted({(sizes[s], round(target[s], 6)) for s in order})
    assert all(0 <= r.copies <= 2 for r in rows)
    taken = sum(r.copies * r.size for r in rows)
    assert taken <= 1.5 * total < taken + 2 * max(r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mixed(empty).count() == 0


# 8 -------------------------------------------------------------------------------------------------------------------


def test_shards(docs, empty):
    rows = sharding.place(docs, 4).collect()
    expected = sorted(str((r[0], len((r[1] or "").encode()) + 1, zlib.crc32(r[1].encode()) if r[1] is not None else None)) for r in corpus())
    assert sorted(str((r.id, r.size, r.crc)) for r in rows) == expected
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    share, largest = sum(load.values()) / 4, max(r.size for r in rows)
    assert all(0 <= s < 4 for s in load) and all(abs(n - share) <= largest + 0.01 * share for n in load.values())
    for s in load:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    out = sharding.sharded(docs, 4)
    assert out.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"] and out.count() == len(rows)
    assert sharding.sharded(empty).count() == 0


def test_sharding_splits_a_hot_text(spark, tmp_path):
    path = str(tmp_path / "hot.parquet")
    spark.createDataFrame([(k, "same text " * 5 if k % 3 == 0 else f"text {k} " * 5) for k in range(3000)], "doc_id long, text string").write.parquet(path)
    load = Counter()
    for r in sharding.place(spark.read.parquet(path)).collect():
        load[r.shard] += r.size
    assert len(load) == 16 and max(load.values()) < 1.02 * min(load.values())


# 9 -------------------------------------------------------------------------------------------------------------------


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").collect()
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found.collect())


def test_language_id_edge_cases(docs, empty):
    model = langid.fit(docs, langid.learnable(docs))
    found, (lang, score) = langid.identify(docs, model)
    rows = found.collect()
    assert found.columns[: len(docs.columns)] == docs.columns and len(rows) == len(corpus())
    assert model.languages == ["de", "en"]
    for r in rows:
        assert (r[lang] == "und") == (not re.search(r"[^\W\d_]", r.text or "")) and 0 <= r[score] <= 1
    assert langid.keep_identified(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(unlabelled).count() == sum(bool(re.search(r"[^\W\d_]", r[1] or "")) for r in corpus())
    assert langid.letters("a²b 12 _x") == {"a": 1, "b": 1, "x": 1}


def test_backoff_takes_the_longest_known_grams():
    table = np.log(np.array([[0.9, 0.1], [0.1, 0.9], [0.5, 0.5]]))
    model = langid.Model(["a", "b"], {"known": 0}, {"<ab": 0, "b": 1}, table)
    assert model.predict("known", {})[0] == "a" and model.predict("abq", {})[0] == "a" and model.predict("qb", {})[0] == "b"
    assert model.predict("zzz", {}) == ("a", 0.5) and model.predict(None, {}) == ("und", 0.0)


# 10 ------------------------------------------------------------------------------------------------------------------

PAGE = '<html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body class="has-sidebar"><nav><a href="/">Home</a></nav><!-- c --><div class="ad">Buy</div>%s<footer>&copy; f</footer></body></html>'


@pytest.mark.parametrize("inner,expected", [
    ("<article><h1>Head &amp; line</h1><p>One<br>two&nbsp; three<p><b>Four.</b></p><p>x</p></article>", "Head & line One two three Four. x"),
    ('<div id="content"><h1>Title here</h1><p>' + "long text " * 12 + '</p><p>Short.</p></div><div class="comments"><p>' + "nice one " * 20 + "</p></div>", "Title here " + "long text " * 12 + "Short."),
    ('<main><p>a</p><form>f <input></form><section id="comments">bad</section><aside>s</aside><div class="cookie-notice">c</div></main>', "a"),
    ('<div class="page-with-sidebar"><article><p>x y</p></article><ol class="comment-list"><li><article class="comment"><p>hello hello</p></article></ol></div>', "x y"),
    ("", ""), ("<article><p>cut of", "cut of"),
])
def test_main_text(inner, expected):
    assert htmltext.main_text(PAGE % inner if "cut" not in inner else PAGE.split("%s")[0] + inner) == expected.strip()


def test_extract_edge_cases(spark):
    pages = [(1, None, None, "t"), (2, "u", "", "t"), (3, "u", "plain words", "t"), (None, "u", "<p>" + "w " * 50_000, "t"), (3, "u", "plain words", "t")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = htmltext.extract(df).collect()
    assert sorted(str((r.page_id, r.url, r.n_chars)) for r in got) == sorted(str(x) for x in [(1, None, 0), (2, "u", 0), (3, "u", 11), (None, "u", 99_999), (3, "u", 11)])
    assert htmltext.extract(df.limit(0)).count() == 0


def test_main_text_of_the_tables_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in htmltext.extract(pages, keep=("page_id", "html")).collect():
        inner = re.split("</article>|<footer", r.html.split("<article>", 1)[1])[0]
        inner = re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", re.sub(r"<[^>]*$", "", inner))
        assert r.text == " ".join(htmltext.html.unescape(inner).split())


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


# Findings of later rounds -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("frame", ["<div class='content with-sidebar'>", "<div id='page' class='has-sidebar'>", "<div class='ad-free-content'>", "<section id='search-algorithms'>", "<div class='widget'>"])
@pytest.mark.parametrize("article", [False, True])
def test_class_words_take_no_article_text(frame, article):
    body = "<h1>Title of it</h1><p>" + "A sentence that goes on for a while. " * 4 + "</p><p class='ad'>Buy now and here</p><p>" + "More of it, plainly told. " * 6 + "</p><p>The end.</p>"
    tag = frame[1 : frame.index(" ")]
    page = f"<html><body><div class='left-sidebar'><p>{'Menu words here. ' * 9}</p></div>{frame}{'<article>' * article}{body}{'</article>' * article}</{tag}><div class='comment-list'><p>{'Reader says. ' * 3}</p></div></body></html>"
    got = htmltext.main_text(page)
    assert got.startswith("Title of it A sentence") and got.endswith("plainly told. The end.") and "Buy now" not in got and "Reader" not in got and "Menu" not in got


def test_few_neighbours_in_small_lists(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((41, 16)) * 3
    rows = [(50 * k if k < 45 else 10**6 + k, (centres[k % 40] + rng.standard_normal(16) * 0.01).tolist()) for k in range(2400)] + [(5 * 10**7 + 50 * k, (centres[40] + rng.standard_normal(16) * 0.01).tolist()) for k in range(3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = Counter(r.query_id for r in ann.search(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), F.col("id") % 50 == 0).collect())
    assert len(found) >= 48 and set(found.values()) == {5}
