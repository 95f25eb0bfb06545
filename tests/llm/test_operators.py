"""Mixing, decontamination, exact search, token files and the n-gram join, against brute force."""

import random
import zlib
from collections import defaultdict

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm import ngram_join as J
from siftstone.llm import source_mix as M
from siftstone.llm import template_leaks as L
from siftstone.llm import token_file as T
from siftstone.llm import vector_topk as V
from siftstone.llm.components import connected_components
from siftstone.llm.queries import QUERIES

# --- mixing ---


def test_targets_fill_up():
    assert M.fill_targets([10, 10], [1, 3], 20) == [5.0, 15.0]
    assert M.fill_targets([1, 100], [3, 1], 101) == [3.0, 98.0]
    assert M.fill_targets([0, 10, 2], [1, 1, 1], 12) == [0.0, 6.0, 6.0] and M.fill_targets([], [], 0) == []


def test_quota_tree_is_exact():
    q = np.array([0, 5, 1000, 37])
    out = M.split_quotas(q, 7, np.random.default_rng(1))
    assert (out.sum(axis=1) == q).all() and np.ptp(out.sum(axis=0)) <= 1 and (out >= 0).all()


def test_mix(spark, docs):
    rng = random.Random(1)
    rows = [(n, "w " * rng.randint(0, 30), f"s{n % 4}") for n in range(800)] + [(n, "w", None) for n in range(800, 830)] + [(5, "a b", "s1")] * 3 + [(None, "a b c", "s2"), (900, None, "s0"), (901, "x " * 50_000, "é")]
    df = docs(*rows)
    sized = M.sized_rows(df)
    got = M.plan_mix(sized).copies(sized).select("_source_key", "doc_id", "size", "source_size", "target", F.size("draws").alias("n"), "draws").collect()
    assert len(got) == len(rows) and max(r.n for r in got) <= 3
    by = defaultdict(lambda: [0, 0])
    for r in got:
        by[r["_source_key"]][0] += r.size
        by[r["_source_key"]][1] += r.size * r.n
    keys = sorted(by, key=lambda k: (k == "n", k))
    targets = M.fill_targets([by[k][0] for k in keys], [1 + i % 3 for i in range(len(keys))], sum(v[0] for v in by.values()))
    for k, t in zip(keys, targets):
        assert abs({r.target for r in got if r["_source_key"] == k}.pop() - t) < 1e-6 and (k == "sé" or by[k][1] <= t and t - by[k][1] <= max(30, 0.01 * t)), k
    shards = defaultdict(int)
    for r in got:
        for d in r.draws:
            assert 0 <= d.shard < M.SHARDS
            shards[d.shard] += 1
    again = M.plan_mix(sized).copies(sized).select("doc_id", "size", F.size("draws").alias("n")).collect()
    assert sorted((r.doc_id or -1, r.size, r.n) for r in again) == sorted((r.doc_id or -1, r.size, r.n) for r in got)
    mixed = M.mix_documents(df.withColumn("draws", F.lit("clash")), M.plan_mix(sized))
    assert mixed.count() == sum(r.n for r in got) and mixed.columns[:6] == [*df.columns, "draws"]
    clash = df.withColumns({"mix_shard": F.lit("clash"), "_kept": F.lit("clash")})
    order = M.shuffled_mix(clash, M.plan_mix(sized))
    assert order.columns == clash.columns and order.count() == mixed.count() == M.mix_documents(clash, M.plan_mix(sized)).where("mix_shard >= 0").count()
    empty = M.sized_rows(df.limit(0))
    assert M.plan_mix(empty).copies(empty).count() == 0


def test_mix_comes_through_the_tree(spark, docs, monkeypatch):
    """Each shard takes as many slots of each source as the tree says, and nothing else is taken."""
    monkeypatch.setattr(M, "BLOCK_DOCS", 10)
    monkeypatch.setattr(M, "SPAN", 3)
    sized = M.sized_rows(docs(*[(n, "w " * (1 + n % 9), f"s{n % 3}") for n in range(900)]))
    split, seen = M.split_quotas, []
    monkeypatch.setattr(M, "split_quotas", lambda *a: seen.append(split(*a)) or seen[-1])
    rows = M.plan_mix(sized).copies(sized).collect()
    blocks = {(r["_source_key"], d.shard) for r in rows for d in r.draws}
    totals = seen[0].sum(axis=0)
    assert np.ptp(totals) <= 1 and {s for _, s in blocks} == set(range(M.SHARDS))
    for k, key in enumerate(sorted({r["_source_key"] for r in rows})):
        assert all(((key, s) in blocks) == (seen[0][k, s] > 0) for s in range(M.SHARDS))
    # A shard's run moved to another shard moves its documents; no run, no documents.
    monkeypatch.setattr(M, "split_quotas", lambda *a: np.zeros_like(split(*a)))
    assert M.plan_mix(sized).copies(sized).agg(F.sum(F.size("draws"))).first()[0] == 0
    monkeypatch.setattr(M, "split_quotas", lambda *a: np.roll(split(*a), 1, axis=1))
    moved = M.plan_mix(sized).copies(sized).agg(F.sum(F.size("draws"))).first()[0]
    assert moved == sum(len(r.draws) for r in rows)


# --- decontamination ---

ITEM = "Alice Smith buys 12 red apples for 3.50 dollars and gives 12 of them to her brother before walking home again slowly"


def leaked(item, text):
    """What leak() says of all windows that item and text share."""
    forms, hits = L.Forms(), []
    sides = [[(template, min(L.WINDOW, len(c)), c) for template, c in ((False, f[0]), (True, f[1]))] for f in (forms(item.split()), forms(text.split()))]
    for (template, width, of_item), (_, _, of_doc) in zip(*sides):
        if not width:
            continue
        places = defaultdict(list)
        for at, h in enumerate(L._windows(of_doc, width, template)):
            places[h].append(at)
        use = L._clear(of_item, width) if template else np.ones(len(of_item) - width + 1, bool)
        hits += [(template, width, n, at) for n, h in enumerate(L._windows(of_item, width, template)) if use[n] for at in places[h]]
    return L.leak(L.Sample(item, forms), L.Sample(text, forms), hits)


def test_templates():
    assert [L.kind(w) for w in ("12", "3.5%", "five", "twenty-five", "Alice", "The", "(apples)", "km", "5kg", "ABC", "")] == [L.NUM, L.NUM, L.WORD_NUM, L.WORD_NUM, L.NAME, L.LITERAL, L.LITERAL, L.UNIT, L.MEASURE, L.LITERAL, L.LITERAL]
    forms = L.Forms()
    same = lambda a, b: forms(a.split())[1].tolist() == forms(b.split())[1].tolist()
    assert same("he ran 5 km with Alice Smith", "he ran 7km with Bob") and same("he has twenty five apples", "he has 25 apples") and same("Yesterday it rained. Today it snows", "yesterday it rained. today it snows")
    assert not same("he ran 5 km", "he ran 5 apples") and not same("12 13", "12") and not same("we met Alice", "we met alice")
    doc = L.Sample("he ran 7km with Alice Smith .", forms)
    assert [doc.value(k) for k in range(7)] == [None, None, "7", "km", None, "Alice Smith", None]


def test_leaks(spark, docs):
    other = ITEM.replace("Alice", "Carol").replace("Smith", "Jones").replace("12", "40").replace("3.50", "9")
    broken = other.replace("40 of", "77 of")
    filler = "nothing of this stands in any question at all and goes on for a while longer"
    bench = spark.createDataFrame([(1, ITEM), (9, ITEM), (2, "too short"), (3, None), (4, ""), (5, "a question of seven words is this")], "item_id long, text string")
    df = docs(f"{filler} {ITEM} {filler}", f"{filler}\n{other}.", f"{broken} {filler}", filler, None, "", "A question of seven words is this!", " ".join(ITEM.split()[3:]), f"{filler} " * 5000 + ITEM, (0, f"{filler} {ITEM} {filler}")).withColumn("item_id", F.lit(0)).withColumn("k1", F.lit("clash"))
    rows = L.find_leaks(df, bench).collect()
    got = {(r.doc_id, r.item_id): r for r in rows}
    assert {k for k in got} == {(0, 1), (1, 1), (6, 5), (7, 1), (8, 1)} and len(rows) == 6
    assert got[0, 1].verbatim and not got[1, 1].verbatim and got[0, 1].covered == len(ITEM.split()) and got[0, 1].items == 2 and got[6, 5].items == 1
    text = df.where("doc_id = 0").first().text
    assert text[got[0, 1].start : got[0, 1].end] == ITEM
    kept = L.drop_leaks(df, bench)
    assert {r.doc_id for r in kept.collect()} == {2, 3, 4, 5} and kept.columns == df.columns
    assert L.find_leaks(df.limit(0), bench).count() == 0 and L.find_leaks(df, bench.limit(0)).count() == 0 and L.drop_leaks(df, bench.limit(0)).count() == 10


def test_inconsistent_stretches_are_cut():
    one_changed = ITEM.replace("12 of", "77 of")
    covered_by = lambda t: (lambda f: f and (f[0], f[3]))(leaked(ITEM, t))
    assert covered_by(one_changed) == (21, True)
    assert covered_by(ITEM.replace("3.50", "12")) == (14, True)
    assert not covered_by(one_changed.replace("Alice Smith", "Carol Jones").replace("12", "40"))
    twice = f"{ITEM} and then Alice meets Alice near the old mill where Alice lives now"
    renamed = twice.replace("Alice", "Carol").replace("Carol lives", "Dana lives")
    assert leaked(twice, renamed)[0] == renamed.split().index("Dana")


def test_slots_agree_across_stretches():
    """The second half is a stretch of its own, behind a literal that differs, and has to agree with the first."""
    item = "a farmer sells 12 baskets of ripe pears to the old baker and later today the baker returns 12 baskets of them to a quiet farmer near the river"
    moved = item.replace("later", "somewhat later").replace("12", "40")
    assert leaked(item, moved)[0] >= 24
    assert leaked(item, moved.replace("returns 40", "returns 50"))[0] < leaked(item, moved)[0]


def test_values_of_several_tokens_align():
    item = "how many days does Anna Maria Lopez need to walk 300 km if she walks twenty five km each day and rests on every third day"
    assert leaked(item, "how many days does Bob need to walk 7km if she walks 3 km each day and rests on every third day")
    assert not leaked(item, "how many days does Bob need to paint 7 doors if he paints 3 walls each week and rests on every fourth night")


def test_literal_copies_are_found_in_any_case():
    dense = "Which Country Won The 1998 World Cup Final Against Brazil In Paris"
    items = [ITEM, dense, "Paris 1998", "12 13 14 15 16 17 18 19 20 21"]
    for item in items:
        for copy in (item, item.lower(), item.upper(), f"({item})!"):
            assert leaked(item, f"so it goes {copy} and on"), copy
        assert not leaked(item, "In Paris in 1998 France Won The 2018 World Cup Final Against Croatia 12 13 14") and not leaked(item, "")


def test_leaks_of_the_query_on_both_sides(spark, docs):
    """Planted: literal, re-parameterised and half copies are found; same shapes, other questions and the query's own documents are held against all windows."""
    con = compare.oracle()
    want = set(con.sql("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall())
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontamination"](spark, compare.DATA).collect()}
    texts, items = dict(con.sql("SELECT doc_id, text FROM documents").fetchall()), con.sql("SELECT item_id, text FROM benchmark").fetchall()
    grams = lambda t: {tuple(w[k : k + 8]) for w in [[L.plain(x) for x in t.split()]] for k in range(max(1, len(w) - 7))}
    of_items = {i: grams(t) for i, t in items}
    brute = set()
    for d, t in texts.items():
        g = grams(t or "")
        for i, item in items:
            if leaked_fast(item, t or "", g & of_items[i]):
                brute.add((d, i))
    assert want <= got and got == brute
    rng, rows = random.Random(11), []
    word = lambda: "".join(rng.choice("abdegiklmnorstu") for _ in range(6))
    bench = []
    for n in range(40):
        w = [word() for _ in range(12)]
        bench.append((n, f"{rng.choice(['Alice', 'Boris'])} {rng.choice(['Smith', 'Jones'])} {w[0]} {rng.randint(10, 99)} {w[1]} {w[2]} {w[3]} {rng.randint(100, 999)} {w[4]} {w[5]} {w[6]} Dora {w[7]} {w[8]} {w[9]} {w[10]} {w[11]} {w[0]}"))
    for n, t in bench:
        words = t.split()
        rows += [(10 * n, f"look here {t} end"), (10 * n + 1, t.replace(words[0], "Zoe").replace(words[1], "Quist").replace(words[3], "7").replace(words[7], "2000").replace(words[11], "Uwe"))]
        rows += [(10 * n + 2, " ".join(rng.sample(words, len(words)))), (10 * n + 3, f"{words[0]} {words[1]} bought {words[3]} books and kept all of them in the cellar for the winter {n}")]
        rows.append((10 * n + 4, " ".join(words[:6] + [word() for _ in words[6:]])))
    found = {(r.doc_id, r.item_id) for r in L.find_leaks(docs(*rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert found == {(10 * n + k, n) for n, _ in bench for k in (0, 1)}


def leaked_fast(item, text, shared):
    """leaked(), but for texts that share neither a plain nor a template window."""
    forms = L.Forms()
    a, b = forms(item.split()), forms(text.split())
    width = min(L.WINDOW, len(a[1]))
    if not shared and not np.intersect1d(L._windows(a[1], width, True), L._windows(b[1], width, True)).size:
        return None
    return leaked(item, text)


# --- exact search ---

LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)


def brute_topk(ids, x, queries, k):
    out = []
    for q in queries:
        best = sorted(((-int(x[q] @ x[j]), ids[j]) for j in range(len(ids)) if ids[j] != ids[q]))[:k]
        out += [(ids[q], n + 1, v, -s) for n, (s, v) in enumerate(best)]
    return out


def test_search_query(spark):
    rows = compare.oracle().sql("SELECT vec_id, embedding FROM embeddings ORDER BY 1").fetchall()
    ids, x = [r[0] for r in rows], np.floor(256 * np.array([r[1] for r in rows], float)).astype(int)
    got = sorted(map(tuple, QUERIES["op7_exact_topk"](spark, compare.DATA).collect()))
    assert got == sorted(brute_topk(ids, x, [n for n, i in enumerate(ids) if i % 50 == 0], 5))


def test_search_edges(spark, monkeypatch):
    monkeypatch.setattr(V, "GROUP_ROWS", 40)
    monkeypatch.setattr(V, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (150, 7)) / 256
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (None, [1.0]), (204, []), (205, [1.0]), (205, [1.0])]
    v = V.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)), "vec_id", "embedding", 256)
    assert v.count() == 153
    ids, full = [*range(150), 204, 205, 205], np.zeros((153, 7), int)
    full[:150], full[151:, 0] = np.floor(256 * x), 256
    asked = v.where("vec_id % 10 = 0")
    got = sorted(map(tuple, V.exact_topk(v, asked, 5).collect()))
    assert got == sorted(brute_topk(ids, full, range(0, 150, 10), 5))
    assert V.exact_topk(v.limit(0), asked, 5).count() == 0 and V.exact_topk(v, asked.limit(0), 5).count() == 0 and V.exact_topk(v.where("vec_id < 3"), v.where("vec_id = 0"), 5).count() == 2


def test_search_prunes(spark):
    """Most pairs are ruled out before their exact score, also of vectors without structure."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(8192, 64)) / 8).astype(np.int64)
    ids, axes = np.arange(len(x)), V.Axes(x[:2048], 64)
    cell = V.Cell(ids[::50], x[::50], np.full(len(ids[::50]), -np.inf), axes, 5)
    for i in range(0, len(x), 1024):
        cell.meet(ids[i : i + 1024], x[i : i + 1024])
    assert cell.compared < 0.45 * cell.met
    decaying = np.floor(256 * rng.normal(size=(8192, 64)) * 0.9 ** np.arange(64) @ np.linalg.qr(rng.normal(size=(64, 64)))[0]).astype(np.int64)
    cell = V.Cell(ids[::50], decaying[::50], np.full(len(ids[::50]), -np.inf), V.Axes(decaying[:2048], 64), 5)
    for i in range(0, len(x), 1024):
        cell.meet(ids[i : i + 1024], decaying[i : i + 1024])
    assert cell.compared < 0.2 * cell.met


def test_search_of_large_components(spark):
    big = 1 << 40
    rows = [(i, [v, 1]) for i, v in enumerate([big, big + 1, -big, 3, 1 << 62, LONG_MAX, LONG_MIN])]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    # Query rows that share an id: the one of the smallest vector counts, wherever it lies.
    twice = spark.createDataFrame([(0, [1, 5]), (0, [1, 2]), (0, [9, 9]), (7, [3, 1]), (8, [1, 3])], "vec_id long, v array<long>")
    for parts in (1, 3):
        assert [tuple(r) for r in V.exact_topk(twice.where("vec_id > 0"), twice.where("vec_id = 0").repartition(parts), 2).orderBy("rank").collect()] == [(0, 1, 8, 7), (0, 2, 7, 5)]
    got = sorted(map(tuple, V.exact_topk(v, v.where("vec_id in (0, 3, 5)"), 4).collect()))
    clip = lambda s: max(LONG_MIN, min(LONG_MAX, s))
    want = []
    for q in (0, 3, 5):
        best = sorted((-clip(rows[q][1][0] * rows[j][1][0] + 1), j) for j in range(len(rows)) if j != q)[:4]
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)


# --- token files ---


def encoded(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*e.ids, 0], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_file(rows, ordered):
    at = 0
    for r, (i, ids) in zip(rows, ordered, strict=True):
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_query(spark):
    docs = compare.oracle().sql("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()
    rows = QUERIES["op8_token_file"](spark, compare.DATA).orderBy("doc_id").collect()
    check_file(rows, zip([i for i, _ in docs], encoded([t for _, t in docs])))


def test_token_edges(spark, docs, monkeypatch):
    import public_tokenizers

    texts = [(3, "a  b   c\n\n d \n"), (1, None), (2, ""), (2, ""), (9, "it's <|endoftext|> x"), (4, "é 漢字 don't,stop"), (None, "z"), (5, "word " * 50_000), (6, "foo. foo foo, Foo\nfoo\nfoo.")]
    df = docs(*texts).withColumn("part", F.lit("clash"))
    out = T.read_token_file(T.write_token_file(df, public_tokenizers.path("byte_bpe_50k.json")))
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    check_file(out.orderBy("start").collect(), zip([i for i, _ in order], encoded([t for _, t in order])))
    assert T.read_token_file(T.write_token_file(df.limit(0), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_units_encode_like_whole_texts():
    import public_tokenizers

    e = T.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    parts = ["the", "of", "foo", "é", "n't", "'s", ",", ".", "!?", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", " ", "\xa0", "1", "漢", "<|endoftext|>", "A"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert e.one(t) == e._encoded(t), t


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [0, 1, 50_257, 2**32 - 1])
def test_codec_round_trip(n, top):
    v = np.random.default_rng(n).integers(0, top, n, endpoint=True, dtype=np.uint32)
    assert (T.unpack(T.pack(v)) == v).all()
    v[::17] = 2**32 - 1
    assert (T.unpack(T.pack(v)) == v).all()


# --- the n-gram join ---


def brute_components(rows, words, percent):
    sets, posts = {}, defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        for g in sets[i]:
            posts[g].append(i)
    root = {i: i for i in sets}

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for j in posts[g]:
                shared[j] += j < i
        for j, n in shared.items():
            if n and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = of(i), of(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), of(i)) for i, s in sets.items()}


def near_copies(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("block, grams", [(512, 1 << 19), (8, 1 << 19), (512, 600)])
def test_components_equal_brute_force(spark, docs, monkeypatch, block, grams):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "BLOCK_GRAMS", grams)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows = []
    for base in range(6):
        words = [rng.choice(vocabulary) for _ in range(120)]
        rows += [near_copies(rng, words, rng.randint(0, 7)) for _ in range(30)]
    rows += [" ".join(rng.choice(vocabulary) for _ in range(60)) + " " + passage for _ in range(60)]
    rows += [None, "", " \t ", "one two", "one two", "ONE TWO", "one two three", "a b c d", "A  b\nc d", "the " * 3000, "the " * 2999]
    df = docs(*rows).withColumn("cid", F.lit("clash")).withColumn("label", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_components(df, 4, 85).collect()}
    assert got == brute_components(list(enumerate(rows)), 4, 85)
    assert len({c for _, c in got.values()}) < len(rows) - 60


@pytest.mark.parametrize("words, percent", [(1, 60), (4, 85)])
def test_contained_pairs_at_the_threshold(spark, docs, words, percent):
    """Sets of which few hashes are low, a text and the same with a passage added, and texts that share some of their n-grams."""
    rng, rows = random.Random(3), []
    hasher = J.NgramHasher(words)
    for family in range(150):
        n = rng.randint(9, 40)
        both = n * 100 // percent
        text = [f"f{family}w{i}" for i in range(both + words - 1)]
        short = text[: n + words - 1]
        low = int((hasher(" ".join(short).encode()) < np.uint64(int(J.LOW_SHARE * 2.0**64))).sum())
        if low < J._beginning(n, percent):
            rows += [" ".join(short), " ".join(text)]
            for k in range(8):
                at = rng.randrange(both)
                rows.append(" ".join(text[at : at + rng.randint(words, 2 * words + 2)] + [f"f{family}x{k}y{i}" for i in range(rng.randint(3, 30))]))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_components(docs(*rows), words, percent).collect()}
    assert got == brute_components(list(enumerate(rows)), words, percent)


def test_join_edges(spark, docs):
    df = docs((None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (4, "q r s t u"), (2, "a b c d e"))
    rows = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in J.ngram_components(df, 4, 85).collect() if r.doc_id is not None)
    assert rows == [(2, 2, 2), (4, 2, 2), (4, 2, 4)]
    kept = J.one_of_each(docs((None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3]
    assert J.ngram_components(df.limit(0), 4, 85).count() == 0


def test_tree_finds_all_partners():
    rng = random.Random(9)
    base = sorted(rng.sample(range(10_000), 120))
    sets = [np.array(sorted(set(rng.sample(base, 100)) | set(rng.sample(range(10_000), 8)))) for _ in range(40)]
    first = [s[: len(s) - -(-80 * len(s) // 100) + 1].tolist() for s in sets]
    tree = J.PrefixTree(first, [len(s) for s in sets], [0] * 40, 80)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            common = np.intersect1d(first[i], first[j])
            if i != j and J.similar(x, y, 80):
                assert len(common) and j in tree.partners(i, common[0])


def test_tree_of_a_long_chain():
    rows = [list(range(k + 1)) for k in range(3000)]
    tree = J.PrefixTree(rows, [3000] * 3000, [0] * 3000, 1)
    assert set(tree.partners(10, 0)) == set(range(3000))


def test_rows_that_share_an_id(spark, docs):
    texts = [(1, "a b c d e f g"), (4, "a b c d e f g"), (4, "q r s t u v"), (4, "z z z z z z z"), (None, "q r s t u v"), (5, ""), (5, None), (6, "q r s t u v")]
    kept = J.one_of_each(docs(*texts).withColumn("_id", F.lit(3))).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, "q r s t u v"), (1, "a b c d e f g"), (4, "q r s t u v"), (5, "")]


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200)], "a long, b long")
    got = {r.node: r.label for r in connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[300] == 100
    assert connected_components(links.limit(0)).count() == 0


