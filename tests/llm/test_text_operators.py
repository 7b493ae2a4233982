"""Pieces, ranked search and collocations against the library and brute force; bulk merges, caches, crowds and passages."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shrinkfit.llm import chat, forest, langid, mix, phrases, pieces, ranked, suffix, tokens, topk
from shrinkfit.llm.bulkbpe import PairTable, merge_words
from shrinkfit.llm.cache import Pieces
from shrinkfit.llm.common import driver_rows, ship
from shrinkfit.llm.tokens import tokenizer_path
from shrinkfit.session import delete_written, written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DDL = "doc_id long, text string, lang string, ids string, rank int, score string, words string"
ODD = [None, "", " ", "  a", "a ", " a  b ", "héllo\nworld", "中文", "▁x", "a▁b", "<s>x</s>", "\0", "", "ﬁ Ａ", "   " * 11 + "x" + " " * 100, "a" * 3000, "\r\n);\r\n\t\tif (x) {\r\n",
       "日本語のテキスト 한국어 текст العربية 😀👍🏽", "x" * 70 + " " * 17 + "y▁▁z  ", "A, a. A! a? B;\x0bb:\x0c c\td"]


@pytest.fixture(scope="module")
def corpus(spark):
    ship(spark)
    rng = random.Random(7)
    vocabulary = ["the", "The", "of", "new", "york", "city", "été", "naïve", "x1", "rare", "a,b", "-"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ". ", "\n", "\t"]) for _ in range(n))
    rows = [(i, text(rng.randint(1, 120)), "en" if i % 3 else None) for i in range(120)]
    rows += [(200 + i, t, "fr" if i % 2 else "en") for i, t in enumerate(ODD)]
    rows += [(300, "new york city " * 2000, "en"), (301, "new york city", "en"), (301, "new york city", "en"), (None, "york new", None), (None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(*r, "clash", 1, "clash", "clash") for r in corpus], DDL).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


# ---- pieces ---------------------------------------------------------------------

def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_pieces_equal_library(docs, corpus, nothing):
    sp, want = library(), Counter()
    for i, t, _ in corpus:
        ids = sp.encode(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += 1
    assert Counter(map(tuple, pieces.pieces_query(docs).collect())) == want
    assert pieces.pieces_query(nothing).count() == 0
    rows = pieces.encode_pieces(docs.select(F.col("doc_id").alias("key"), F.col("text").alias("body"), "ids"), doc_id="key", text="body")
    back = {r.doc_id: r.text for r in pieces.decode_pieces(rows).collect()}
    assert back[300] == "new york city " * 2000 and back[208] == " x"


def test_pieces_of_random_texts():
    sp, model, rng = library(), pieces.piece_model(), random.Random(1)
    parts = ["a", "e", "th", "ing", " ", " ", "  ", "▁", "\r", ";", ")", "(", "中", "執", "é", "😀", "\n", "\t", "\0", "1", "2", "Å"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    offsets, ids = model.encode(pa.array(texts))
    want = sp.encode(texts)
    assert [ids[a:z].tolist() for a, z in itertools.pairwise(offsets.tolist())] == want
    assert model.decode(offsets, ids).to_pylist() == [sp.decode(x) for x in want]


def test_pieces_are_the_same_with_a_small_cache_and_pair_table(monkeypatch):
    monkeypatch.setattr(pieces, "PAIRS", 3)
    model = pieces.PieceModel(tokenizer_path("piece_bpe_32k.model"), cached=2000)
    texts = ["the cat sat on the mat", "thonningly eddstion", "   \n x"] * 5
    for _ in range(2):
        offsets, ids = model.encode(pa.array(texts))
        assert [ids[a:z].tolist() for a, z in itertools.pairwise(offsets.tolist())] == library().encode(texts)


def test_decode_of_any_ids():
    sp, model = library(), pieces.piece_model()
    for ids in ([1, 300, 2], [259, 260], [3 + 0xE4, 3 + 0xB8, 3 + 0xAD], [0, 300], []):
        assert model.decode(np.array([0, len(ids)]), np.array(ids, dtype=np.int32)).to_pylist() == [sp.decode(ids)]
    with pytest.raises(ValueError):
        model.decode(np.array([0, 1]), np.array([32000], dtype=np.int32))


def test_cache_keeps_what_comes_again():
    cache = Pieces(4000)
    for k in range(200):
        _, missing = cache.find(["often", f"once{k}"])
        for i in missing:
            cache.put(["often", f"once{k}"][i], b"1234")
        assert k == 0 or 0 not in missing
    assert len(cache.young) + len(cache.old) < 30


def test_bulk_merges_equal_one_by_one():
    rng = random.Random(5)
    pairs = {}
    names = list(range(6))
    while len(pairs) < 60:
        a, b = rng.choice(names), rng.choice(names)
        if (a, b) not in pairs:
            pairs[a, b] = (len(pairs), len(names))
            names.append(len(names))
    table = PairTable(*(np.array(x) for x in zip(*((a, b, m) for (a, b), (_, m) in pairs.items()))))
    words = [[rng.randrange(6) for _ in range(rng.randint(1, 20))] for _ in range(500)]
    ids, lens = merge_words(np.array(sum(words, [])), np.array([len(w) for w in words]), table)
    want = []
    for w in words:
        w = list(w)
        while True:
            found = [(pairs[p][0], k) for k, p in enumerate(itertools.pairwise(w)) if p in pairs]
            if not found:
                break
            k = min(found)[1]
            w[k : k + 2] = [pairs[w[k], w[k + 1]][1]]
        want.append(w)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == want


# ---- ranked search ------------------------------------------------------------------

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def best(corpus, items, k=20):
    counts = [(i, Counter(terms(t))) for i, t, *_ in corpus]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, c), size in zip(counts, sizes):
            m = 100 - 25 + 25 * size * n // total if size else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if absent else i, -s) for r, (s, absent, i) in enumerate(sorted(found)[:k], 1)]
    return out


ITEMS = [(1, "new york, NEW york! city"), (2, "été naïve rare"), (3, None), (4, ""), (5, "nosuchword"), (6, "the of"), (7, "york"), (None, "rare x1"), (8, "中文 text " * 50), (7, "city")]


def test_ranked_equals_brute_force(spark, docs, corpus, nothing, monkeypatch):
    items = spark.createDataFrame([(*x, 9, "c") for x in ITEMS], "item_id long, text string, rank int, doc_id string")
    got = lambda rows: Counter(map(tuple, rows.collect()))
    want = Counter(best(corpus, ITEMS))
    assert got(ranked.ranked_query(docs, items)) == want
    assert ranked.ranked_query(nothing, items).count() == 0 and ranked.ranked_query(docs, items.limit(0)).count() == 0
    monkeypatch.setattr(ranked, "BLOCK", 300)  # several blocks
    assert got(ranked.ranked_search(docs, items, k=3)) == Counter(best(corpus, ITEMS, 3))


def test_ranked_bounds_lose_nothing():
    """Small runs, random vectors: what pruning leaves equals full products."""
    rng = np.random.default_rng(2)
    for trial in range(20):
        n, v = 300, 40
        dense = rng.integers(1, 1000, (n, v)) * (rng.random((n, v)) < rng.uniform(0.02, 0.5))
        w = rng.integers(1, 50, v)
        length = np.sqrt((w * dense.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-length)
        queries = []
        for q in range(5):
            own = np.sort(rng.choice(v, 8, replace=False))
            times = rng.integers(1, 3, 8)
            queries.append((q, own, w[own] * times, math.sqrt(float((w[own] * times.astype(float) ** 2).sum()))))
        kept = [i for i in order if dense[i].any()]
        rows = pa.RecordBatch.from_arrays([pa.array([int(i) for i in kept]), pa.array(length[kept]), *(pa.array([np.asarray(x, "<i4").tobytes() for x in y], pa.binary()) for y in ([np.flatnonzero(dense[i]) for i in kept], [dense[i][dense[i] > 0] for i in kept]))], ["doc_id", "length", "codes", "impacts"])
        size, ranked.RUN = ranked.RUN, 16
        found = {(q, i): s for b in ranked.search_bucket([rows], queries, {}, 4) for q, i, s in zip(*(c.to_pylist() for c in b.columns))}
        ranked.RUN = size
        for q, own, weights, _ in queries:
            score = dense[:, own] @ weights
            want = sorted(((-s, i) for i, s in enumerate(score.tolist()) if s > 0))[:4]
            assert {(q, i): -s for s, i in want} == {k: s for k, s in found.items() if k[0] == q}


# ---- collocations ---------------------------------------------------------------------

def mined(corpus, least=10, top=2000):
    count, n = Counter(), Counter()
    for _, text, lang in corpus:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for d in (1, 2, 3):
                count.update((lang or "und", tuple(w[k : k + d])) for k in range(len(w) - d + 1))
    out = []
    for lang in n:
        found = []
        held = {p: a for (x, p), a in count.items() if x == lang and len(p) > 1 and a >= least}
        for p, a in held.items():
            if any(100 * b >= 50 * a for q, b in held.items() if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))):
                continue
            cuts = [(math.floor(Fraction(10**6 * a * a, count[lang, p[:k]] * count[lang, p[k:]])), k) for k in range(1, len(p))]
            s, k = min(cuts)
            found.append((-s, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return out


def test_collocations_equal_brute_force(docs, corpus, nothing, monkeypatch):
    got = lambda rows: sorted(map(tuple, rows.collect()))
    want = sorted(mined(corpus))
    assert want and got(phrases.collocations(docs)) == want
    assert phrases.collocations(nothing).count() == 0
    # Many ranges, so that words and pairs are shared by several; windows put together as they come.
    monkeypatch.setattr(phrases, "RANGE", 300)
    monkeypatch.setattr(phrases, "GATHER", 50)
    assert got(phrases.collocations(docs, least=4, top=30)) == sorted(mined(corpus, 4, 30))


def test_one_pair_everywhere(spark):
    """A third of all windows begin with one pair, with different words after it."""
    rows = [(i, "alpha beta " + f"w{i} " + ("alpha beta" if i % 2 else ""), "en") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    assert sorted(map(tuple, phrases.collocations(df).collect())) == sorted(mined(rows))


def test_quicksort_counts():
    rng = np.random.default_rng(1)
    for least in (1, 3, 10):
        rows = rng.integers(1, 6, (400, 3))
        rows[rng.random(400) < 0.1, 1:] = 0
        rows[rng.random(400) < 0.1, 2] = 0
        weight = rng.integers(1, 4, 400)
        want = Counter()
        for r, w in zip(rows.tolist(), weight.tolist()):
            for d in (1, 2, 3):
                if 0 not in r[:d]:
                    want[tuple(r[:d])] += w
        got = Counter()
        for depth, at, n in phrases.quicksort_counts(rows, weight, least):
            for r, m in zip(rows[at, :depth].tolist(), n.tolist()):
                assert tuple(r) not in got
                got[tuple(r)] = m
        assert got == {p: n for p, n in want.items() if n >= least}


# ---- crowds, passages, mix ---------------------------------------------------------------

def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(4)
    for share in ((85, 100), (80, 100)):
        for _ in range(300):
            n = int(rng.integers(1, 900))
            both = rng.integers(0, 2**63, n, dtype=np.uint64)
            a = np.unique(np.concatenate([both, rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 2)), dtype=np.uint64)]))
            b = np.unique(np.concatenate([both, rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 2)), dtype=np.uint64)]))
            x, y = (forest.parities(np.zeros(len(s), np.int64), s, 1).view("<u8") for s in (a, b))
            same = len(np.intersect1d(a, b))
            if share[1] * same >= share[0] * (len(a) + len(b) - same):
                assert forest.in_reach(x, y, np.array([len(a) + len(b)]), share).all()


def test_pairs_of_a_crowd_grow_with_its_rows(spark):
    """Near copies of one text with a word changed, without the text itself: links only where the same word is changed."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(40)]
    made = {}
    for n in (400, 1600):
        rows = []
        for i in range(n):
            w = list(base)
            w[rng.randrange(40)] = f"n{i}"
            rows.append((i, " ".join(w)))
        seen = set(written(spark))
        classes = forest.near_query(spark.createDataFrame(rows, "doc_id long, text string")).select("component_id").distinct().count()
        new = [p for p in written(spark) if p not in seen]
        count = lambda name: sum(spark.read.parquet(p).count() for p in new if re.search(name, p))  # noqa: B023, E731
        made[n] = count("near-crowd-pairs|near-rest")
        assert classes <= 44 and count("forest-pairs") <= forest.TREES * forest.LEAF / 2 * n
        delete_written(spark, new)
    assert made[1600] <= 5 * made[400] + 1000 and made[1600] <= 5 * 1600


def test_passages_shared_with_several_documents(spark):
    """X = L + C, Y = L and the start of C (50 words shared in all), Z = C: X's span is all of L and C; and random mosaics by brute force."""
    rng = random.Random(11)
    fresh = iter(range(10**6))
    prose = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    texts = []
    for lead in (5, 10, 20) * 4:
        head, core = prose(lead), prose(70)
        texts += [prose(9) + head + core + prose(9), prose(7) + head + core[: 50 - lead] + prose(30), prose(3) + core + prose(8)]
    blocks = [prose(rng.randint(10, 60)) for _ in range(12)]
    texts += [sum((rng.choice([rng.choice(blocks), prose(rng.randint(1, 20))]) for _ in range(10)), []) for _ in range(40)]
    at = {}
    for i, w in enumerate(texts):
        for k in range(len(w) - 49):
            at.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = set()
    for i, w in enumerate(texts):
        hit = [k for k in range(len(w) - 49) if len(at[tuple(w[k : k + 50])]) > 1]
        while hit:
            start = end = hit[0]
            while hit and hit[0] <= end + 50:
                end = hit.pop(0)
            want.add((i, start, end + 50))
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {(r.doc_id, r.start, r.end) for r in suffix.passages_query(rows).collect()} == want


def test_mix_of_one_id(spark):
    """All rows of a source share an id: the target is met nevertheless."""
    rows = [(7, f"{'w ' * (1 + k % 9)}{k}", "a") for k in range(300)] + [(None, f"x y {k}", "b") for k in range(300)] + [(k, "z z z z", "c") for k in range(50)]
    got = mix.mix_query(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size, took, target = Counter(), Counter(), {}
    for r in got:
        took[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(took[s] - target[s]) <= 10 for s in took) and len(took) == 3


def test_long_conversations_are_dealt_and_null_ids_stay_apart(spark):
    ship(spark)
    texts = ["", "### user: x</turn>", "a\\b", "long " * 50, "ok"]
    rows = [(c, t, ("user", "assistant")[t % 2], texts[(c + t) % 5] + str(t)) for c, n in ((1, 47), (2, 10), (3, 11), (4, 1)) for t in range(n)]
    rows += [(None, t, "assistant", f"same {t % 3}") for t in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    many = [r.asDict(recursive=True) for r in chat.format_conversations(df, prefixes=10).collect()]
    whole = [r.asDict(recursive=True) for r in chat.format_conversations(df).collect()]
    order = lambda r: (r["conv_id"] or 0, r["formatted"])
    assert sorted(many, key=order) == sorted(whole, key=order)
    assert sorted(r["conv_id"] or 0 for r in many) == [0] * 30 + [1, 2, 3, 4]
    first = next(r for r in many if r["conv_id"] == 1)
    assert chat.parse(first["formatted"]) == [(role, text) for c, _, role, text in rows if c == 1]
    assert [s["turn"] for s in first["spans"]] == list(range(47))
    # A template that rewrites history is found whatever part it shows in.
    def moving(turns):
        return "".join(t for _, t in turns) + f"[{len(turns) > 20}]"
    assert {r.conv_id: r.rewrites for r in chat.format_conversations(df.filter("conv_id <= 2"), moving, prefixes=10).collect()} == {1: True, 2: True}
    assert not any(r["rewrites"] for r in many)


@pytest.mark.parametrize("block_rows", [40, 1000])
def test_top_k_with_repeats_and_clashing_columns(spark, block_rows):
    """Queries travel to several index blocks, or to several copies of one; repeated query ids, ties and columns named like the operator's own."""
    ship(spark)
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6)], int(i), 1.5, "b") for i in [*range(300), 10, 20, 20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block long, score double, query_id string").repartition(3)
    vectors = topk.quantised(df, "vec_id", "embedding", 4)
    index, dims, width = topk.build_index(vectors, block_rows)
    got = topk.search(index, dims, width, vectors.filter("vec_id % 10 = 0"), 4, block_queries=8).collect()
    want = []
    for q, v, *_ in rows:
        if q % 10 == 0:
            best = sorted((-sum(int(16 * a * b) for a, b in zip(v, w)), i) for i, w, *_ in rows if i != q)[:4]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_top_k_index_is_shuffled_once(spark):
    """Twice the queries don't copy the index again: its copies depend on slots and blocks alone."""
    ship(spark)
    df = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * k) for k in range(1, 9)]).alias("embedding"))
    vectors = topk.quantised(df, "vec_id", "embedding", 64)
    index, dims, width = topk.build_index(vectors, 20)
    for every in (10, 1):
        plan = topk.search(index, dims, width, vectors.filter(F.col("vec_id") % every == 0), 3, block_queries=16)._jdf.queryExecution().executedPlan().toString()
        joined = plan[plan.index("SortMergeJoin"):]
        assert plan.index("MapInArrow") < plan.index("SortMergeJoin") and "hashpartitioning(block" not in plan[: plan.index("SortMergeJoin")]
        assert joined.count("Exchange hashpartitioning(block") == 2


def grams(text):
    """Counts of hashed byte 3-grams, one by one."""
    data = [b if b >= 128 or chr(b).isalpha() else 32 for b in f" {text.lower()} ".encode()]
    out, m = Counter(), (1 << 32) - 1
    for a, b, c in zip(data, data[1:], data[2:]):
        h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & m
        out[((h ^ h >> 15) * 0x27D4EB2F & m) >> 20] += 1
    return out


def nearest_centroid(text, model):
    """(language, cosine, rejected) in plain Python."""
    if text is None or not re.search(r"[^\W\d_]", text) or not model.languages:
        return "und", 0.0, True
    x = {f: math.log(1 + n) * float(model.idf[f]) for f, n in grams(text).items()}
    size = math.sqrt(sum(v * v for v in x.values()))
    cosines = [sum(v * float(c[f]) for f, v in x.items()) / size for c in model.centroids]
    best = max(range(len(cosines)), key=lambda i: (cosines[i], -i))
    return model.languages[best], cosines[best], cosines[best] < model.floors[best]


def spoken(rng, k, n):
    """n words of language k, each language with its own syllables."""
    own = random.Random(k)
    syllables = ["".join(own.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(50)]
    return " ".join("".join(rng.choices(syllables, k=2)) for _ in range(n))


def test_language_equals_plain_nearest_centroid(spark):
    ship(spark)
    rng = random.Random(4)
    train = [(i, spoken(rng, i % 3, 30) + (" Été" if i % 4 == 0 else ""), f"l{i % 3}") for i in range(240)] + [(900, None, "l0"), (901, "12", "l1"), (902, "word", None)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    learned = [t for _, t, lang in train if lang and t and re.search(r"[^\W\d_]", t)]
    freq = Counter(f for t in learned for f in grams(t))
    assert np.allclose(model.idf, [math.log((1 + len(learned)) / (1 + freq[f])) + 1 for f in range(langid.FEATURES)], rtol=1e-5)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4) and sorted(set(model.languages)) == ["l0", "l1", "l2"]
    new = [(i, spoken(rng, i % 5, 1 + i % 40)) for i in range(120)] + [(200, None), (201, ""), (202, "..3"), (203, "A"), (204, spoken(rng, 1, 8000)), (205, "ÉTÉ straße"), (205, "ÉTÉ straße")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in new], "doc_id long, text string, rejected string").repartition(3)
    got = sorted((r.doc_id, r.language.lang, r.language.score, r.language.rejected) for r in langid.with_language(frame, model).collect())
    assert len(got) == len(new)
    for (doc_id, lang, score, rejected), (want_id, text) in zip(got, sorted(new, key=lambda r: r[0])):
        name, cosine, no = nearest_centroid(text, model)
        assert (doc_id, lang) == (want_id, name) and score == pytest.approx(cosine, abs=1e-4)
        assert rejected == no or abs(cosine - float(model.floors[model.languages.index(name)])) < 1e-4


def test_encoder_memory_is_bounded(spark):
    """Tables of the encoder are made from few characters at a time, and words are merged in runs, whatever their number; the ids don't depend on it."""
    def most(run):
        tracemalloc.start()
        try:
            out = run()
            return out, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    kinds, took = most(tokens.character_kinds)
    assert took < 16 << 20
    assert [kinds[ord(c)] for c in "aé中1٣ \u2003-😀"] == [tokens.LETTER] * 3 + [tokens.NUMBER] * 2 + [tokens.SPACE] * 2 + [tokens.OTHER] * 2
    enc = tokens.encoder(tokenizer_path())
    rng = np.random.default_rng(5)
    lens = rng.integers(1, 12, 200_000)
    symbols = enc.first[rng.integers(97, 123, lens.sum())]
    (ids, sizes), took = most(lambda: merge_words(symbols, lens, enc.pairs))
    assert took < 40 << 20  # one run over all of them takes some 70 MB
    some = slice(0, 3000)
    for run in (1, 7, 1000, 10**9):
        few, n = merge_words(symbols[: lens[some].sum()], lens[some], enc.pairs, run)
        assert n.tolist() == sizes[some].tolist() and few.tolist() == ids[: n.sum()].tolist()
    assert [len(x) for x in merge_words(symbols[:0], lens[:0], enc.pairs)] == [0, 0]


def test_driver_rows_start_no_worker(spark):
    """The driver's own rows are a local table; by ``createDataFrame`` of tuples they passed Python workers of another kind."""
    rows = [(1, 2, 3), (4, 5, 6)]
    df = driver_rows(spark, rows, "a long, b long, c long")
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in df.orderBy("a").collect()] == rows and df.dtypes == [(c, "bigint") for c in "abc"]


def test_pipeline_equals_plain_python(spark, tmp_path):
    """run() against each stage in plain Python: language, exact copies, near copies, mix (sorted, in DuckDB) and packing."""
    duckdb = pytest.importorskip("duckdb")
    import corpus_pipeline
    from tokenizers import Tokenizer

    ship(spark)
    rng = random.Random(12)
    rows, base = [], spoken(rng, 0, 70).split(" ")
    for i in range(240):
        rows.append((i, spoken(rng, i % 3, rng.randint(8, 90)), f"l{i % 3}"))
    for i in range(20):  # one word of 70 changed: 61 of 71 shingles, or more at the ends, are shared with the first text
        copy = list(base)
        copy[3 * i] = f"abc{'xyz'[i % 3]}{'def'[i % 2]}"
        rows.append((300 + i, " ".join(copy), "l0"))
    rows += [(400 + i, rows[i][1].upper() if i % 2 else rows[i][1], rows[i][2]) for i in range(15)]
    rows += [(500, "12 34 !!", "l1"), (501, None, "l1"), (502, "", None), (503, spoken(rng, 2, 3000), "l2")]
    rows += [(510 + i, spoken(rng, 9, 60), None) for i in range(6)]
    rows = [(i, t, lang, None if i % 7 == 0 else f"s{0 if i % 3 else i % 5}", len(t or "")) for i, t, lang in rows]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, ddl).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = langid.fit(spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2], ddl))
    docs = [r for r in rows if not nearest_centroid(r[1], model)[2]]
    assert not {500, 501, 502} & {r[0] for r in docs} and len(docs) > 240
    last = {}
    for r in docs:
        last[r[1].translate(LOWER)] = max(r, last.get(r[1].translate(LOWER), r))
    docs = sorted(last.values(), key=lambda r: r[0])
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (re.findall(r"[^\x20\x09-\x0D]+", r[1].translate(LOWER)) for r in docs)]
    head = list(range(len(docs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and head[i] != head[j]:
            low, high = sorted((head[i], head[j]))
            head = [low if h == high else h for h in head]
    docs = [r for k, r in enumerate(docs) if head[k] == k]
    assert sum(300 <= r[0] < 320 for r in docs) < 20
    con = duckdb.connect()
    kept = pa.table({c: [r[k] for r in docs] for k, c in enumerate(["doc_id", "text", "lang", "source", "n_chars"])})  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM kept")
    copies = {doc_id: n for doc_id, n in con.execute(f"SELECT doc_id, taken // size FROM ({mix.MIX_SQL})").fetchall()}
    library = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for doc_id, text, *_ in docs:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) - 2048 * ((len(ids) - 1) // 2048)
        ends = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, z) in enumerate(zip(ends, ends[1:])):
            want[doc_id, k, a, z - a, zlib.crc32(ids[a:z].tobytes())] += copies[doc_id]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    gaps = []  # plain best fit of falling lengths
    for length in sorted((r.length for r in got), reverse=True):
        fits = [g for g in gaps if g >= length]
        gap = min(fits, default=2048)
        if fits:
            gaps.remove(gap)
        gaps.append(gap - length)
    assert len(places) <= len(gaps) + 1


def test_passages_end_at_words_of_like_hashes(spark):
    """Words whose hashes agree in 16 bits are different words: neither end of a passage takes one in, and 49 words are no passage."""
    names = [f"q{i}" for i in range(3000)]
    hashes = forest.word_hashes(pa.array([" ".join(names)], pa.large_string()))[1]
    like = {}
    for name, h in zip(names, hashes.tolist()):
        like.setdefault(h >> 17 & 0xFFFF, []).append(name)
    pairs = [x[:2] for x in like.values() if len(x) > 1][:6]
    assert len(pairs) == 6
    rng = np.random.default_rng(31)
    word = lambda n: [f"z{x}" for x in rng.integers(0, 10**9, n)]
    rows = []
    for k, (a, b) in enumerate(pairs):
        shared = word(60 if k < 3 else 49)
        rows += [(10 * k, " ".join([*word(30), a, *shared, a, *word(30)])), (10 * k + 1, " ".join([*word(20), b, *shared, b, *word(30)]))]
    got = suffix.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in got) == sorted([(10 * k, 31, 91) for k in range(3)] + [(10 * k + 1, 21, 81) for k in range(3)])


def test_shingles_are_counted_over_every_row(spark, monkeypatch):
    """However many shingles there are, those of many rows are never among a set's rarest."""
    import pyarrow as pa

    from shrinkfit.llm import forest
    monkeypatch.setattr(forest, "COUNTED", 1, raising=False)    # a bound by which rows were once left out of the counts
    shared = "one phrase that all rows hold at their end"
    rows = [(i, i, 24, " ".join(f"w{i}x{k}" for k in range(17)) + " . " + shared) for i in range(40)]
    marked = spark.createDataFrame(rows, "rid long, class long, n_shingles long, text string")
    common = set(forest.sets(pa.array([shared]), 3)[0].view("int64").tolist())
    got = forest.rarest(marked, 3, (85, 100)).collect()
    assert len(common) == 7 and {r.rid for r in got} == set(range(40))
    assert not common & {r.shingle for r in got}
