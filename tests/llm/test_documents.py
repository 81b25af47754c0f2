"""The text operators against brute force, on hand-made documents with every awkward row."""

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from caselink.llm import minhash_dedup, mixing, pieces, pii, repeats, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, label string, score string, kept string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, passage = prose(1, 200), prose(2, 80)
    near = base.split()
    near[100] = "changed"
    out = [(0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "One TWO"), (8, prose(3, 30) + " " + passage + " " + prose(4, 30)), (9, prose(5, 40) + " " + passage),
           (10, "mail a.b@x.org ip 10.0.0.1 card 4539578763621486 call +1 (202) 555-0143 now"), (10, "mail a.b@x.org ip 10.0.0.1 card 4539578763621486 call +1 (202) 555-0143 now"), (None, prose(6, 50)), (11, "line of words here\n" * 60),
           (12, "é日本😀 ▁x  y <|endoftext|> <s>\x00 " * 5), (13, prose(7, 20000)), (14, "a" * 3000)]
    # a dense group: 90 texts that each change one word of a base, more than a small bucket holds
    group = prose(8, 120).split()
    for i in range(90):
        words = list(group)
        words[(i * 7) % 120] = f"v{i}"
        out.append((100 + i, " ".join(words)))
    return [(i, t, "en", None if (i or 0) % 5 == 4 else f"s{(i or 0) % 3}", len(t or ""), 1, "x", "y", "z") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_components(rows, num=85):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(lowered(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("small", [64, 4])
def test_near_duplicates(docs, rows, small):
    want = brute_components(rows)
    got = minhash_dedup.near_duplicates(docs, small=small).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_at_the_threshold_of_the_pipeline(spark):
    """Pairs from 0.79 to 0.87: those from 0.80 link in the pipeline's stage, those from 0.85 in the query."""
    rows = []
    for g in range(12):
        base = prose(50 + g, 300).split()
        rows.append((1000 + 10 * g, " ".join(base)))
        for k in (4, 5, 6, 7):
            words = list(base)
            for x in range(k):
                words[20 + 40 * x] = f"g{g}k{k}x{x}"
            if g % 4 == k - 4:
                rows.append((1000 + 10 * g + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = {}
    for num in (80, 85):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs, num=num).collect()}
        assert got == brute_components(rows, num)
        linked[num] = sum(i != c for i, (_, c) in got.items())
    assert linked == {80: 9, 85: 3}


def test_odd_sketches_estimate_similarity():
    x = np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64)
    flips = lambda a, b: sum(bin(i ^ j).count("1") for i, j in zip(*(minhash_dedup.odd_sketch(minhash_dedup.samples(s, 120)) for s in (a, b)), strict=True))
    assert flips(x, x) == 0 and flips(x, np.r_[x[:920], x[:80] + np.uint64(1)]) <= minhash_dedup.most_flips(0.85, 120) < flips(x[:300], x[700:])


def test_personal_data(docs, rows):
    by_id = {i: t for i, t, *_ in rows}
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in pii.find_personal_data(docs).collect()}
    text = by_id[10]
    assert [(text[a:b], k) for a, b, k in got[10]] == [("a.b@x.org", "email"), ("10.0.0.1", "ip"), ("4539578763621486", "card"), ("+1 (202) 555-0143", "phone")]
    assert got[3] == got[4] == []
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[10].text == "mail [EMAIL] ip [IP] card [CARD] call [PHONE] now" and clean[0].text == by_id[0] and clean[3].text is None and clean[10].label == "x"


def test_personal_data_parsers_equal_their_patterns():
    pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def plain(t):
        out = []
        for k, (kind, p) in enumerate(pattern.items()):
            for m in re.finditer(p, t):
                d = re.sub(r"\D", "", m.group())
                if (kind == "ip" and any(int(x) > 255 for x in m.group().split("."))) or (kind == "card" and not (14 <= len(d) <= 19 and pii.luhn(d))) or (kind == "phone" and not 10 <= len(d) <= 15):
                    continue
                out.append((m.start(), k, m.end(), kind))
        return [(a, b, k) for a, _, b, k in sorted(out)]

    anchors, r = pii.automaton(), random.Random(3)
    for _ in range(4000):
        s = "".join(r.choice(["@", "a", "b.", "1", "23", ".", " ", "-", "+", "(", "4539578763621486", "255", "9", "+1 234", "x@y.z", "%"]) for _ in range(r.randint(1, 14)))
        assert [x for x in pii.spans_of(s, anchors) if x[2] in pii.BASE] == plain(s)
    account = lambda t: [t[a:b] for a, b, k in pii.spans_of(t, anchors) if k == "account"]
    assert account("iBAN: de89370400440532013000") == ["de89370400440532013000"] and account("aCCount 12345678") == ["12345678"]
    assert account("IBAN DE00370400440532013000") == account("account details 1234 and 5678") == account("account is 12345678") == []
    assert account("IBAN DE89 3704 0044 0532 0130 00 was used") == ["DE89 3704 0044 0532 0130 00"] and account("passport no. N1234567, İ") == ["N1234567"]
    assert [s[2] for s in pii.spans_of("IBAN: DE89 3704 0044 0532 0130 00, see https://a.b/c.", anchors) if s[2] not in pii.BASE] == ["account", "url"]


def near_targets(got):
    """No document with a repetition left fits what is missing, and one more of the smallest wouldn't come nearer."""
    got = got[got.mix_size > 0]
    for _, g in got.groupby(got.source.fillna("null source")):
        gap = g.mix_target.iloc[0] - (g.mix_size * g.mix_copies).sum()
        smallest = g.mix_size[g.mix_copies < 3].min()
        assert (g.mix_copies <= 3).all() and (np.isnan(smallest) or -smallest / 2 <= gap <= max(smallest / 2, 0.5)), (gap, smallest)


def test_mixing_with_ties_and_null_ids(spark, rows):
    """Repeated rows are taken in part; rows without an id are documents of their own; clashing names pass."""
    own = [(None if i % 2 else i % 40, "w " * (i % 7 + 1) * (50 if i % 3 else 1), f"s{i % 4}", 1, 2, 3, 4, 5, 6) for i in range(400)] * 2
    names = ["doc_id", "text", "source", "size", "key", "n", "part", "bound", "mix_size"]
    docs = spark.createDataFrame(own, "doc_id long, text string, source string, size int, key int, n int, part int, bound int, mix_size int")
    got = mixing.mix(docs).select("row.doc_id", "row.source", "mix_size", "mix_target", "mix_copies").toPandas()
    assert len(got) == 800
    near_targets(got)
    for _, g in got.groupby("source"):
        assert abs((g.mix_size * g.mix_copies).sum() / g.mix_target.iloc[0] - 1) < 0.001
    out = mixing.mixed(docs)
    assert out.columns == names and out.count() == got.mix_copies.sum() and out.where("mix_size <> 6 or n <> 3").isEmpty()


def test_mixing_reaches_targets(docs, rows):
    flat = lambda d: mixing.mix(d).select("row.doc_id", "row.source", "mix_size", "mix_source_size", "mix_target", "mix_copies").toPandas()
    got = flat(docs)
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, fixed = {}, {}
    while True:
        free = [s for s in order if s not in fixed]
        share = (sum(size.values()) - sum(fixed.values())) / max(sum(weight[s] for s in free), 1)
        over = [s for s in free if share * weight[s] > 3 * size[s]]
        if not over:
            target = fixed | {s: share * weight[s] for s in free}
            break
        fixed |= {s: 3.0 * size[s] for s in over}
    for r in got.itertuples():
        s = None if r.source is None or pd.isna(r.source) else r.source
        assert r.mix_source_size == size[s] and r.mix_target == pytest.approx(target[s]) and 0 <= r.mix_copies <= 3
    near_targets(got)
    again = flat(docs.repartition(3))
    key = lambda d: sorted(zip(d.doc_id.fillna(-1), d.mix_size, d.mix_copies, strict=True))
    assert key(got) == key(again)
    assert mixing.mixed(docs).count() == got.mix_copies.sum() and mixing.mixed(docs).columns == docs.columns


def test_pieces_equal_the_library(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.piece_model())
    got = pieces.decode(pieces.encode(docs, pieces.piece_model()), pieces.piece_model()).select("text", "ids", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        want = sp.encode(r.text or "")
        assert list(r.ids) == want and r.decoded == sp.decode(want)
    both = pieces.round_trip(docs, pieces.piece_model()).select("text", "ids", "decoded").collect()
    assert sorted(both, key=repr) == sorted(got, key=repr)
    for r in pieces.digests(docs, pieces.piece_model()).join(docs.select("doc_id", "text"), "doc_id").collect():
        want = sp.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(sp.decode(want).encode()).hexdigest())


def test_long_words_merge_alike():
    m, r = pieces.model_of(pieces.piece_model()), random.Random(4)
    for _ in range(50):
        w = "▁" + "".join(r.choice("abcdeinrst▁日é.") for _ in range(200)).replace("▁", "")
        assert m.segment([w])[0] == m.segment_long(w)


def test_token_counts_equal_the_library(docs, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_counts.byte_vocabulary())
    got = token_counts.count_tokens(docs, token_counts.byte_vocabulary()).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in got:
        assert r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode())


def test_prefix_counts_and_budgets(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_counts.byte_vocabulary())
    v = token_counts.vocabulary_of(token_counts.byte_vocabulary())
    word = b" internationalisation"
    for n, c in enumerate(v.prefix_counts([word])[0], 1):
        assert c == len(lib.encode(word[:n].decode(), add_special_tokens=False).ids)
    assert list(v.prefix_counts([word * 9])[0]) == list(v._long(word * 9))
    text = "hello world of prefixes"
    table = token_counts.prefix_table(text, token_counts.byte_vocabulary())
    assert table[0] == 0 and table[-1] == len(lib.encode(text).ids) and len(table) == len(text) + 1
    kept = {r.doc_id: r.kept_bytes for r in token_counts.fit_budget(docs.where("doc_id in (3, 6, 8)"), token_counts.byte_vocabulary(), 10).collect()}
    assert kept[3] == 0 and kept[6] == 7 and 10 <= kept[8] < 100


def test_prefix_counts_of_whole_texts_equal_the_library(spark):
    """At every character of texts full of white space, contractions and special strings; budgets end at characters."""
    from tokenizers import Tokenizer

    path = token_counts.byte_vocabulary()
    lib, r = Tokenizer.from_file(path), random.Random(6)
    bits = ["\n", "\n", " ", " ", "'s", "'re", "'ve", "'ll", "'", "!!", "word", "the ", "日本", "é", "12", "<|endoftext|>", "don't", "x"]
    texts = ["\n\n's!!"] + ["".join(r.choices(bits, k=r.randint(1, 12))) for _ in range(400)]
    want = {t: [len(lib.encode(t[:n], add_special_tokens=False).ids) for n in range(len(t) + 1)] for t in texts}
    for t in texts:
        table, at = token_counts.prefix_table(t, path), np.cumsum([0, *(len(c.encode()) for c in t)])
        assert [int(table[i]) for i in at] == want[t], repr(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for g in token_counts.fit_budget(docs, path, 3).collect():
        t = texts[g.doc_id]
        assert g.kept_bytes == len(t[: max(n for n, c in enumerate(want[t]) if c <= 3)].encode())


def brute_repeats(texts, n):
    seen = collections.Counter(b[i : i + n] for b in texts for i in range(len(b) - n + 1))
    out = []
    for b in texts:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                cover[i] += 1
                cover[i + n] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(docs, rows):
    want = sorted(zip([-1 if r[0] is None else r[0] for r in rows], brute_repeats([(r[1] or "").encode() for r in rows], 200), strict=True))
    for hot in (repeats.HOT, 3):  # as a whole, and with most hashes' windows dealt one by one
        found = repeats.remove_repeats(docs, hot=hot).collect()
        got = sorted((-1 if r.doc_id is None else r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in found)
        assert got == want


def test_a_long_run_of_one_hash_is_told_in_parts(monkeypatch):
    """Rows of one hash in many batches, places repeated at the seams: each place once, all hot; a lone hash is dropped."""
    import pyarrow as pa

    places = [(5, i.to_bytes(16, "big"), 0, 9, False, i) for i in range(40) for _ in range(3)] + [(6, b"x" * 16, 0, 9, False, 1)]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
    cols = [pa.array(c, t) for c, t in zip(zip(*places, strict=True), types, strict=True)]
    batch = pa.RecordBatch.from_arrays(cols, names=["least", "k", "w0", "w1", "twice", "print"])
    monkeypatch.setattr(repeats, "LONG_RUN", 20)
    told = [r for out in repeats._shared(10)(iter([batch.slice(i, 10) for i in range(0, len(places), 10)])) for r in out.to_pylist()]
    assert {(r["least"], r["k"]) for r in told} == {p[:2] for p in places[:-1]} and all(r["hot"] for r in told)


def test_kept_text_of_repeats(docs):
    got = repeats.remove_repeats(docs, keep_text=True).where("doc_id in (0, 6, 8)").collect()
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got) and len(got) == 3


@pytest.mark.parametrize("letters, length", [(2, 16), (3, 21), (30, 48)])
def test_suffix_arrays_against_sorted_bytes(letters, length):
    """Order and common prefixes of an array, the marks of a family and its levels, by comparing bytes one by one."""
    r, family, every = np.random.default_rng(letters), repeats.SuffixFamily(length), []
    known = r.integers(0, letters, 400).astype(np.uint8)
    for _ in range(25):
        parts = [r.integers(0, letters, 60).astype(np.uint8), known[(i := r.integers(0, 300)) : i + 70], r.integers(0, letters, 30).astype(np.uint8)]
        text = np.concatenate(parts)
        at = np.arange(len(text) - length + 1)
        wins = [text[i : i + length].tobytes() for i in at]
        order, common = repeats.suffix_array(np.r_[text, np.zeros(8, np.uint8)], at, length)
        assert [wins[i] for i in order] == sorted(wins)
        for x, y, c in zip(order, order[1:], common[1:], strict=False):
            assert c == next((i for i in range(length) if wins[x][i] != wins[y][i]), length)
        family.add(text, at)
        every += wins
    times = collections.Counter(every)
    assert family.marks().tolist() == [times[w] > 1 for w in every]
    held = [[level.text[i : i + length].tobytes() for i in level.at] for level in family.levels]
    assert len(held) <= 7 and all(h == sorted(h) for h in held) and sorted(sum(held, [])) == sorted(times)


def test_toxicity_finds_planted_words(spark):
    r = random.Random(5)
    text = lambda bad: " ".join([prose(r.random(), 40), *([r.choice(["blorgface", "snarkworm", "zintlehead"]) for _ in range(3)] if bad else []), prose(r.random(), 20)])
    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(2000, None), (2001, "")], "doc_id long, text string").withColumn("score", F.lit("kept out"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 902 and held and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert next(r for r in got if r.doc_id == 2000).predicted == 0
    flipped = labels.withColumn("toxic", F.when(toxicity._held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)
    none = toxicity.score_toxicity(docs, labels.where("toxic = 0"), keep_columns=docs.columns)
    assert none.where("predicted = 1").isEmpty() and none.select("row.*").columns == docs.columns


def test_toxicity_evidence_by_brute_force(spark):
    """Every string keeps its own value, those seen once too; others fall back by their context, and unknown contexts are 0."""
    r = random.Random(11)
    made = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 14))) for _ in range(400)]
    train = [(int(i % 3 == 0), " ".join(r.choices(made, k=12))) for i in range(90)] + [(1, "onlyonce")]
    counts = [collections.Counter(), collections.Counter()]
    for y, t in train:
        for w in t.split():
            counts[y].update(toxicity._strings(w))
    strings, d = counts[0].keys() | counts[1].keys(), toxicity.DISCOUNT
    n3 = collections.Counter(g[-3:] for g in strings)
    n2, kinds2, n1 = collections.Counter(), collections.Counter(), collections.Counter()
    for x, n in n3.items():
        n2[x[:-1]] += n
        kinds2[x[:-1]] += 1
        n1[x[-1]] += 1
    sums, kinds = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for y in (0, 1):
        for g, n in counts[y].items():
            sums[y][g[:-1]] += n
            kinds[y][g[:-1]] += 1

    def value(g):
        c = g[:-1]
        left = [d * kinds[y][c] / sums[y][c] if sums[y][c] else 1 for y in (0, 1)]
        if g not in strings:
            return np.log(left[1] / left[0])
        x = g[-3:]
        p = (max(n3[x] - d, 0) + d * kinds2[x[:-1]] * n1[x[-1]] / len(n3)) / n2[x[:-1]]
        q = [(max(counts[y][g] - d, 0) / sums[y][c] if sums[y][c] else 0) + left[y] * p for y in (0, 1)]
        return np.log(q[1] / q[0])

    models = toxicity.fit_models(spark.createDataFrame(train, "label int, text string"))
    assert models.selectExpr("sum(length(letters))").first()[0] == len(strings)
    texts = [(i, " ".join([*r.choices(made, k=9), "onlyonce", "".join(r.choice("abczé") for _ in range(11))])) for i in range(40)] + [(40, None), (41, "7 !")]
    got = {x.doc_id: x for x in toxicity.document_features(spark.createDataFrame(texts, "doc_id long, text string"), models).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        words = toxicity.WORD.findall(t or "")
        want = toxicity.features(np.array([sum(value(g) for g in toxicity._strings(w)) for w in words]))
        assert np.allclose([got[i][f] for f in toxicity.FEATURE_NAMES], want, atol=0.02)


def test_toxicity_counts_all_rows_outside_the_sample(spark, monkeypatch):
    class Seen(Exception):
        pass

    def fit(train):
        raise Seen(train.count())

    monkeypatch.setattr(toxicity, "MOST_FITTED", 10)
    monkeypatch.setattr(toxicity, "fit_models", fit)
    docs = spark.range(300).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    with pytest.raises(Seen) as got:
        toxicity.score_toxicity(docs, labels)
    assert got.value.args[0] == docs.where(~toxicity._held_out("doc_id")).count() - 10


def test_empty_tables(spark, empty):
    assert minhash_dedup.near_duplicates(empty).isEmpty()
    assert pii.find_personal_data(empty).isEmpty() and pii.redact(empty).isEmpty()
    assert mixing.mixed(empty).isEmpty()
    assert pieces.encode(empty, pieces.piece_model()).isEmpty() and pieces.digests(empty, pieces.piece_model()).isEmpty()
    assert token_counts.count_tokens(empty, token_counts.byte_vocabulary()).isEmpty()
    assert repeats.remove_repeats(empty).isEmpty()
    assert toxicity.score_toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")).isEmpty()
