"""The numbered operators on small rows: nulls, empty and odd texts, ties, repeated rows, empty tables, clashing columns."""

import bisect
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shrinkfit.llm import chat, exact, forest, langid, mix, pack, suffix, tokenfile, topk, warc
from shrinkfit.llm.common import scratch, ship
from shrinkfit.llm.tokens import encoder, tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, row string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def corpus(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["été", "Straße", "naïve,", "x y"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    base, passage = text(120).split(" "), text(60)
    rows = [(i, text(int(rng.integers(1, 90)))) for i in range(40)]
    for k in range(30):  # near copies of one text
        copy = list(base)
        copy[(7 * k) % 120] = f"new{k}"
        rows.append((100 + k, " ".join(copy)))
    rows += [(200, passage + " " + text(30)), (201, text(20) + "\n" + passage), (202, passage)]
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "One"), (304, "one"), (305, "a  b \n c"), (306, "12 34 !!"), (307, text(6000)), (308, "ONE"), (None, "no id"), (309, "dup"), (309, "dup")]
    return [(i, t, "en" if i is not None and i % 3 else None, None if i and i % 5 == 0 else f"s{(i or 0) % 4}", len(t or ""), 7, "r") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DDL).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


def ids_of(text):
    return np.array([*encoder(tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_equals_library(corpus):
    texts = [t for _, t, *_ in corpus] + ["it's  we'll\u0085 x", "<|endoftext|> a", "日本 12", " a", "a ", "\n\n x"]
    offsets, ids = encoder(tokenizer_path()).encode(pa.array(texts), 0)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == ids_of(t).tolist()


def test_encoder_equals_fresh_library():
    """Texts with an added token's string, beside others and alone, against a tokenizer as its file gives it."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path())
    for texts in (["a <|endoftext|> b", "plain  text", "<|endoftext|>", None, "x<|endoftext|><|endoftext|> \n y", "<|endoftext |>"], ["<|endoftext|> only"]):
        want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
        for end in (None, 0):
            offsets, ids = encoder(tokenizer_path()).encode(pa.array(texts), end)
            assert [ids[a:z].tolist() for a, z in zip(offsets[:-1], offsets[1:])] == [x + ([] if end is None else [end]) for x in want]
    assert 50256 in want[0]


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(200)]
    rows += [(300, None), (350, [None] * 8), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (500, rows[7][1]), (501, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r)[:4] for r in topk.top_k_query(df).collect())
    v = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) for i, x in rows if x is not None and None not in x and np.isfinite(x).all()}
    want = []
    for q in (i for i in v if i % 50 == 0):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k_query(df.limit(0)).count() == 0


def test_carry_save_select():
    values = np.random.default_rng(2).integers(0, 50, 130)
    slices = topk.bitmaps(values, 7)
    everyone = topk.bitmaps(np.ones(130, np.int64), 1)[0]
    for k in (1, 5, 64, 130, 200):
        assert sorted(topk.select(slices, everyone, k)) == sorted(sorted(range(130), key=lambda i: (-values[i], i))[:k])


def test_language(spark, small_dir):
    table = spark.read.parquet(f"{small_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([None, "", "12 !!"])], "doc_id long, text string")
    got = langid.language_query(table.unionByName(extra, allowMissingColumns=True)).join(table.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.lang]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and [r.lang_pred for r in got if r.doc_id >= 10**6] == ["und"] * 3
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    kept = langid.keep_identified(table.unionByName(extra, allowMissingColumns=True))
    assert kept.columns == table.columns and kept.count() >= 0.99 * table.count() and not kept.filter("doc_id >= 1000000").count()


def test_language_rejects_and_handles_no_labels(docs, nothing):
    assert langid.language_query(nothing).count() == 0
    model = langid.fit(docs)
    rows = {r.doc_id: r.language for r in langid.with_language(docs.select("doc_id", "text"), model).collect()}
    assert rows[300].lang == "und" and rows[306].rejected and not rows[1].rejected
    none = langid.with_language(docs.select("text"), langid.fit(docs.filter("lang IS NULL")))
    assert {r.language.lang for r in none.collect()} == {"und"}


def test_language_rejects_what_was_never_seen(spark):
    ship(spark)
    rng = np.random.default_rng(23)
    # Languages of their own syllables; the last one has no label.
    syllables = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(60)] for _ in range(4)]
    text = lambda k: " ".join("".join(rng.choice(syllables[k], 2)) for _ in range(60))
    noise = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), 400))
    train = [(i, text(i % 3), f"l{i % 3}") for i in range(900)] + [(900 + i, noise(), "l0") for i in range(2)] + [(910, text(1), "l2")]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    new = [(i, text(i % 3)) for i in range(600)] + [(1000 + i, text(3)) for i in range(100)] + [(2000 + i, noise()) for i in range(100)]
    got = {r.doc_id: r.language for r in langid.with_language(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert sum(not got[i].rejected for i in range(600)) >= 0.99 * 600
    assert sum(got[1000 + i].rejected for i in range(100)) >= 95 and sum(got[2000 + i].rejected for i in range(100)) >= 95


def test_chat_round_trip(spark):
    ship(spark)
    odd = ["\\", "### user: x</turn>\n", "a\\### b", "</turn", "", None, "é\n\n", "</turn>" * 3, ": :", "\\\\</turn>"]
    rows = [(1, k, ("user", "assistant", "sys:tem", None)[k % 4], t) for k, t in enumerate(odd)] + [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    got = {r.conv_id: r for r in chat.chat_query(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in (1, 2, -7, None):
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv] if conv != -7 else [(r, "\\### Assistant: </turn> ok") for r in ("user", "assistant")]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.rewrites) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), False)
    assert chat.chat_query(df.limit(0)).count() == 1  # number -7
    own = spark.createDataFrame([(-7, 0, "user", "the table's")], "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id, r.n_turns) for r in chat.chat_query(own).collect()) == [(-7, 1), (-7, 2)]


def test_rewriting_template_is_found():
    last_only = lambda turns: f"[{len(turns)}]" + "".join(t for _, t in turns[-1:])
    assert chat.locate([("a", "x"), ("b", "y")], last_only)[2]
    closing = lambda turns: "".join(f"<{r}>{t}" for r, t in turns) + "."
    text, spans, _ = chat.locate([("a", "<"), ("b", "x.")], closing)
    assert [text[s["text_start"] : s["text_end"]] for s in spans[1:]] == ["x."]


def test_passages(docs, corpus, nothing):
    at, texts = {}, [(i, words(t)) for i, t, *_ in corpus if i is not None]
    for i, w in texts:
        for k in range(len(w) - 49):
            at.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = set()
    for i, w in texts:
        hit = [k for k in range(len(w) - 49) if len(at[tuple(w[k : k + 50])]) > 1]
        while hit:
            start = end = hit[0]
            while hit and hit[0] <= end + 50:
                end = hit.pop(0)
            want.add((i, start, end + 50))
    got = {(r.doc_id, r.start, r.end) for r in suffix.passages_query(docs).collect()}
    assert got == want and want
    assert suffix.passages_query(nothing).count() == 0


def test_passages_of_copies_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    copy, shared, own = prose(60), prose(55), prose(70)
    rows = [(i, copy) for i in (3, 4, 5, 5)]  # copies, one of them twice
    rows += [(7, shared + " " + prose(20)), (7, prose(30) + " " + shared)]  # one id, two texts: doesn't count
    rows += [(8, own), (8, own), (9, prose(49)), (10, None), (None, copy)]
    rows += [(11, prose(10) + " " + copy + " " + prose(10))]
    got = {(r.doc_id, r.start, r.end) for r in suffix.passages_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 0, 60), (4, 0, 60), (5, 0, 60), (11, 10, 70)}
    rows += [(12, shared)]
    got = suffix.passages_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.end) for r in got if r.doc_id in (7, 12)} == {(7, 0, 85), (12, 0, 55)}  # word numbers of both texts of 7
    assert all(r.other != r.doc_id for r in got)


def test_crowded_beginnings_are_resolved(spark):
    """A beginning of 30 words that 60 documents share; the passage across it is shared by pairs that don't sort beside each other."""
    rng = np.random.default_rng(10)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    line = prose(30)
    left = [prose(22) for _ in range(12)]
    rows = [(i, prose(40) + " " + left[i % 12] + " " + line + " " + prose(40)) for i in range(24)]
    rows += [(100 + i, prose(40) + " " + line + " " + prose(40)) for i in range(36)]
    got = {(r.doc_id, r.start, r.end) for r in suffix.passages_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 40, 92) for i in range(24)}


def test_runs_of_one_word_differ(spark):
    """Runs of one word each: 16-bit hashes of words alone would make some of them equal."""
    rows = [(i, " ".join([f"w{i}"] * 52)) for i in range(700)]
    assert suffix.passages_query(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_minimisers_are_shared():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 2**63, 50).astype(np.uint64)
    a, b = (np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64), shared]) for n in (40, 77))
    ha, hb = suffix.runs(a, 25), suffix.runs(b, 25)
    assert set(ha[suffix.minimisers(ha, 26)]) & set(hb[suffix.minimisers(hb, 26)]) & set(suffix.runs(shared, 25))


@pytest.mark.parametrize("width,share", [(3, (85, 100)), (5, (80, 100))])
def test_near_groups(docs, corpus, width, share):
    sets = {}
    for i, t, *_ in corpus:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets if i is not None}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i in parent:
        for j in parent:
            both = len(sets[i] & sets[j])
            if i < j and both and share[1] * both >= share[0] * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in forest.near_groups(docs, width=width, share=share).collect()}
    assert got == {i: (len(sets[i]), root(i) if i is not None else None, i is None or root(i) == i) for i in sets}


def test_near_stage(docs, nothing):
    kept = forest.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id BETWEEN 100 AND 129").count() == 1
    assert forest.near_query(nothing).count() == 0 and forest.drop_near_copies(nothing).count() == 0


def test_near_links_in_a_crowd(spark):
    """A template that 1,300 documents share crowds the regions; the links between documents of one filling, far apart by id, are all found."""
    ship(spark)
    rng = np.random.default_rng(21)
    template = [f"t{x}" for x in range(150)]
    filling = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows = []
    for i in range(1000):
        own = filling(24)
        rows.append((i, " ".join(template + own)))
        if i < 300:
            rows.append((9000 - i, " ".join(template + own[:11] + filling(13))))
    sets = {i: {tuple(t.split(" ")[k : k + 3]) for k in range(172)} for i, t in rows}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    assert all(linked(i, 9000 - i) for i in range(300)) and not any(linked(i, i + 1) for i in range(999))
    got = forest.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=3, share=(85, 100)).collect()
    recall = sum(r.component_id == 9000 - r.doc_id for r in got if r.doc_id > 8000) / 300
    assert recall == 1 and all(r.component_id == r.doc_id for r in got if r.doc_id < 8000), recall


def test_near_stage_of_an_id_with_different_texts(spark):
    ship(spark)
    rng = np.random.default_rng(22)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(0, 10**9, 80)) for _ in range(3))
    near = c + " more"
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (6, b + " more"), (7, c), (7, near), (8, near), (9, None), (9, c + " more again")], "doc_id long, text string")
    kept = sorted((tuple(r) for r in forest.drop_near_copies(df).collect()), key=str)
    of_c = [r for r in kept if r[0] == 7]
    assert [r for r in kept if r[0] != 7] == [(3, a), (5, b), (9, None)] and of_c in ([(7, c)], [(7, near)])


@pytest.mark.parametrize("threshold", [0.85, 0.8])
def test_estimate_loses_fewer_links_than_the_trees(threshold):
    n, least = forest.HASHES, threshold - forest.DOUBT * (threshold * (1 - threshold) / forest.HASHES) ** 0.5
    lost = sum(math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(n) if k / n < least)
    assert lost < min(2e-7, (1 - threshold**forest.BASE) ** forest.TREES), lost


def test_leaves_get_deeper():
    tree = np.zeros(400, np.int64)
    prefix = np.zeros((400, forest.DEPTH), np.uint16)
    prefix[:, forest.BASE] = np.arange(400) // 20
    found = np.bincount(forest.leaves(prefix, tree))
    assert found.max() <= forest.LEAF and len(found) == 20


def test_token_files(docs, corpus, nothing):
    rows = [tuple(r) for r in tokenfile.token_files_query(docs).collect()]
    want, at = [], 0
    for i, t, *_ in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0)):
        e = ids_of(t)
        want.append((i, at, len(e), zlib.crc32(e.tobytes())))
        at += len(e)
    key = lambda r: (r[1], r[2])
    assert sorted(rows, key=key) == want
    assert tokenfile.token_files_query(nothing).count() == 0


def test_token_files_deal_rows_of_one_id(spark):
    df = spark.createDataFrame([(None, f"text {i} of a null id") for i in range(300)] + [(i, f"x {i}") for i in range(100)], "doc_id long, text string")
    manifest = tokenfile.write_tokens(df, scratch(spark, "tokens"), files=8)
    assert max(r.n_docs for r in manifest.collect()) < 200
    rows = tokenfile.read_tokens(manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None] * 300 + list(range(100))
    assert [r.start for r in rows[1:]] == [a.start + a.n_tokens for a in rows[:-1]]


def test_section_round_trip():
    ids = np.random.default_rng(1).integers(0, 70_000, 5003).astype(np.uint32)
    data = tokenfile.encode_section(np.array([4, 9]), np.array([5000, 3]), ids)
    head = tokenfile._HEAD.unpack(data[: tokenfile._HEAD.size])
    at = tokenfile._HEAD.size
    by_rank = np.frombuffer(data, "<u4", head[2], at)
    at += 4 * head[2] + 12 * head[0]
    assert (by_rank[tokenfile.decode_ranks(head[1], np.frombuffer(data, np.uint8, head[3], at), np.frombuffer(data, np.uint8, head[4], at + head[3]))] == ids).all()


def test_exact(docs, corpus, nothing):
    groups = {}
    for i, t, *_ in corpus:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact.exact_query(docs).collect())
    want = []
    for t, g in groups.items():
        keep = max((i for i in g if i is not None), default=None)
        want += [(str(i), str(keep), len(g), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in g]
    assert got == sorted(want)
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact.exact_query(nothing).count() == 0 and exact.drop_exact_copies(nothing).count() == 0


def test_index_survives_the_session_entry(spark):
    path = scratch(spark, "index-test")
    first = exact.DigestIndex(spark, path, expected=17_500_000)
    first.add(spark.createDataFrame([("a", 5), ("b", 2), ("a", 7)], "digest string, doc_id long"))
    first.close()
    again = exact.DigestIndex(spark, path)
    again.add(spark.createDataFrame([("a", 9), ("c", 1)], "digest string, doc_id long"))
    assert sorted(tuple(r) for r in again.table().collect()) == [("a", 7), ("b", 2), ("c", 1)]


def test_mix(docs, corpus, nothing):
    rows = mix.mix_query(docs).collect()
    assert len(rows) == len(corpus)
    total = {}
    for i, t, _, s, *_ in corpus:
        total[s] = total.get(s, 0) + len(words(t))
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, open_sources, left = {}, set(order), sum(total.values())
    while open_sources:
        level = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if level * weight[s] > 3 * total[s]}
        for s in full or open_sources:
            target[s] = 3 * total[s] if full else level * weight[s]
            left -= target[s] if full else 0
        open_sources -= full or open_sources
    source = {i: s for i, _, _, s, *_ in corpus}
    took = {}
    for r in rows:
        s = source[r.doc_id]
        assert r.target == pytest.approx(target[s]) and r.source_size == total[s] and r.taken <= 3 * r.size
        took[s] = took.get(s, 0) + r.taken
    largest = max(len(words(t)) for _, t, *_ in corpus)
    assert all(abs(took[s] - target[s]) <= largest for s in took)
    out = mix.mix_sources(docs)
    assert out.columns == docs.columns
    assert out.select(F.sum(mix.word_count(F.col("text")))).first()[0] == sum(took.values())
    assert mix.mix_query(nothing).count() == 0 and mix.mix_sources(nothing).count() == 0


def test_pack(docs, corpus, nothing):
    rows = pack.pack(docs, 64).collect()
    texts = {}
    for i, t, *_ in corpus:
        texts[i] = ids_of(t)
    total, sequences = 0, {}
    for r in rows:
        piece = texts[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32
        assert r.piece == 0 or r.length == 64
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    assert total == sum(len(ids_of(t)) for _, t, *_ in corpus)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.05 * total / 64 + 2
    assert pack.pack(nothing).count() == 0


def test_match_rounds_places_all():
    sizes = {s: int(n) for s, n in enumerate(np.random.default_rng(8).integers(0, 50, 100), start=1)}
    placed, n = pack.match_rounds(sizes, 100)
    spans = {}
    for size, first, number, sequence, offset in placed:
        for k in range(number):
            spans.setdefault(sequence + k, []).append((offset, size))
    assert sum(number for _, _, number, _, _ in placed) == sum(sizes.values()) and len(spans) == n
    for parts in spans.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 100
    gaps = []  # best-fit decreasing, one document after the other
    for size in sorted((s for s, k in sizes.items() for _ in range(k)), reverse=True):
        k = bisect.bisect_left(gaps, size)
        gap = gaps.pop(k) if k < len(gaps) else 100
        bisect.insort(gaps, gap - size)
    assert n <= 1.01 * len(gaps) + 1


def test_warc(spark):
    ship(spark)
    long, short = "é" * 600, "s" * 999
    rows = [(1, "http://a", long), (2, "http://b\r\nX: y", long), (7, None, long), (3, "u", short), (4, "u", short), (5, "u", None), (6, "u", ""), (8, "u", "x" * 1000), (9, "u", "r" * 1500), (9, "u", "r" * 1500), (None, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_query(df).collect())
    want = []
    for k, (i, _, html) in enumerate(rows):
        data = (html or "").encode()
        refers = {1: 7, 2: 7, None: 7}.get(i) or (9 if k == 9 else None)
        want.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.warc_query(df.limit(0)).count() == 0
    manifest = warc.write_warc(df, scratch(spark, "warc-roll"), roll=500, files=1)
    assert manifest.count() > 3 and warc.read_warc(manifest).count() == len(rows)


def test_pipeline(spark, docs, nothing, small_dir):
    import corpus_pipeline

    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, small_dir).persist()
        assert name == "packing" or rows.columns == docs.columns
    assert rows.count() > 0
    empty = nothing
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, small_dir)
    assert empty.count() == 0
