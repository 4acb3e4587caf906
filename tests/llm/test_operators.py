"""Corpus operators against brute force, on small fixtures with awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

ROWS = "doc_id long, text string, lang string, spans string"


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and long texts, multi-byte letters, repeats inside one text."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = text(120), text(60)
    texts = [text(r.randint(1, 90)) for _ in range(40)] + [base] * 5
    for _ in range(12):
        w = base.split(" ")
        w[r.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [f"{text(20)}\n{passage} {text(20)}" for _ in range(6)]
    texts += [None, "", "", "   ", "one two", "one two", "Á B c d", "á b C d", "x" * 900, "word " * 80, text(3000), "a <|endoftext|> b"]
    return [(k, t, "en", "clash") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ROWS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, and a row that repeats as a whole."""
    return spark.createDataFrame([(1, "alpha beta gamma", "x", ""), (1, "alpha beta gamma", "x", ""), (None, "alpha beta gamma", None, None), (2, None, None, None), (2, "other " * 60, None, None)], ROWS)


def test_bpe_matches_the_tokenizer(docs, empty, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillspark.llm.bpe import ForcedBoundaryBPE, encode_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = encode_documents(docs, path).collect()
    assert len(rows) == len(corpus())
    for row in rows:
        ids = t.encode(row.text or "", add_special_tokens=False).ids
        assert (row.ids, row.n_tokens, row.decoded) == (ids, len(ids), t.decode(ids, skip_special_tokens=False))
    assert encode_documents(empty, path).count() == 0
    assert encode_documents(odd, path, digests=True).count() == 5
    coder = ForcedBoundaryBPE(open(path, encoding="utf-8").read())
    hard = ["İSTANBUL ΣΑΣ Σ", "é́x\x1cy\x85z", "don't we'll 12345", "😀👍🏽!!", "a" * 400, "ﬁ Ǆ ẞ", "日本語テキスト", "<|ENDOFTEXT|>", "q" * 47 + " " + "xyzab" * 20]
    for text, (n, ids, decoded) in zip(hard, coder.documents(hard), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and n == len(want)
        assert decoded == t.decode(want, skip_special_tokens=False)
        assert coder.ids(text) == want


@pytest.mark.parametrize("length,gram,group", [(20, 8, 4000), (20, 8, 1), (200, 100, 4000)])
def test_string_dedup_against_all_windows(docs, length, gram, group):
    from quillspark.llm.string_dedup import drop_repeated_strings

    bodies = {k: (t or "").encode() for k, t, *_ in corpus()}
    met = Counter(b[k : k + length] for b in bodies.values() for k in range(len(b) - length + 1))
    got = {r.doc_id: r for r in drop_repeated_strings(docs, length, gram=gram, group=group).collect()}
    assert set(got) == set(bodies)
    for k, b in bodies.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if met[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans) == (len(b), sum(gone), spans), k
        assert bytes(got[k].kept) == bytes(x for x, y in zip(b, gone, strict=True) if not y)


def test_string_dedup_edges(empty, odd):
    from quillspark.llm.string_dedup import drop_repeated_strings

    assert drop_repeated_strings(empty, digests=True).count() == 0
    got = drop_repeated_strings(odd, 10, gram=4, digests=True).orderBy("n_bytes").collect()
    assert [r.n_removed for r in got] == [0, 16, 16, 16, 360]


def test_bwt_against_all_windows():
    from quillspark.llm.bwt import repeated_runs

    rng = np.random.default_rng(0)
    for trial in range(60):
        length = int(rng.integers(2, 20))
        parts = [rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(0, 60))) for _ in range(int(rng.integers(1, 8)))]
        text = np.concatenate([np.append(p, -1) for p in (*parts, parts[0])])
        want = defaultdict(list)
        for k in range(len(text) - length + 1):
            if (text[k : k + length] >= 0).all():
                want[tuple(text[k : k + length])].append(k)
        got = defaultdict(list)
        for p, g in zip(*repeated_runs(text, length), strict=True):
            got[int(g)].append(int(p))
        assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1), trial


def test_exact_groups(docs, empty, odd):
    from quillspark.llm.exact_dedup import exact_groups

    best = {}
    for k, t, *_ in corpus():
        best.setdefault(t or "", []).append(k)
    for block in (4, 4096):
        for r in exact_groups(docs, block=block).collect():
            text = corpus()[r.doc_id][1] or ""
            assert (r.keep_id, r.group_size, r.kept) == (max(best[text]), len(best[text]), r.doc_id == max(best[text]))
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert exact_groups(empty).count() == 0
    got = exact_groups(odd).collect()
    assert len(got) == 5 and sorted(r.group_size for r in got) == [1, 1, 3, 3, 3] and sum(r.kept for r in got) == 3


def test_shards(docs, empty, odd):
    from quillspark.llm.sharding import shard_by_bytes

    rows = shard_by_bytes(docs, 5).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(corpus())))
    sizes = Counter()
    slots = defaultdict(list)
    homes = defaultdict(set)
    for r in rows:
        text = corpus()[r.doc_id][1] or ""
        assert r["size"] == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        homes[text].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    share = sum(sizes.values()) / 5
    longest = max(r["size"] for r in rows)
    assert max(abs(sizes[k] - share) for k in range(5)) <= longest + share * 0.125
    assert shard_by_bytes(empty, 5).count() == 0
    assert shard_by_bytes(odd, 3).count() == 5
    assert {r.shard for r in shard_by_bytes(odd, 1).collect()} == {0}


def test_contamination(spark, docs, empty, odd):
    from quillspark.llm.decontaminate import contamination

    texts = {k: t for k, t, *_ in corpus()}
    passage = texts[60].split("\n")[1].split(" ")[:60]
    near = list(passage)
    near[30] = "changed"
    bench = spark.createDataFrame([(10, " ".join(passage).upper()), (11, " ".join(near)), (12, None), (13, "one two"), (14, "never seen words stand here at all")], "item_id long, text string")
    got = {r.doc_id: r for r in contamination(docs, bench).collect()}
    assert set(got) == set(texts)

    def bag(words):
        m = min(5, len(words))
        return Counter(tuple(words[k : k + m]) for k in range(len(words) - m + 1)), m

    for k, t in texts.items():
        words, want = (t or "").lower().split(), []
        for item, text in ((10, " ".join(passage)), (11, " ".join(near)), (13, "one two")):
            b, m = bag(text.lower().split())
            n = len(text.split())
            for s in range(max(1, len(words) - n + 1)):
                w = words[s : s + n]
                if len(w) >= m:
                    c = Counter(tuple(w[x : x + m]) for x in range(len(w) - m + 1))
                    if sum((b & c).values()) >= 0.75 * sum((b | c).values()):
                        want.append(item)
                        break
        assert (got[k].item_ids, got[k].contaminated) == (want, bool(want)), k
    assert contamination(empty, bench).count() == 0
    assert not contamination(odd, bench.limit(0)).filter("contaminated").count()
    assert contamination(odd, bench).count() == 5


def test_contamination_between_alignments(spark):
    """Words put in inside and others at both ends: the best window lies between two alignments of the item."""
    from quillspark.llm.decontaminate import contamination

    item, other = [f"i{k}" for k in range(59)], [f"o{k}" for k in range(80)]
    layouts = [other[:40] + item[a:c] + ["n1", "n2", "n3"][:new] + item[c:e] + other[40 : 40 + tail] for a in (0, 1, 2) for c in (7, 12, 30) for new in (1, 2, 3) for e in (56, 58, 59) for tail in (0, 1, 30)]
    bag = lambda w: Counter(tuple(w[x : x + 5]) for x in range(len(w) - 4))
    b, want = bag(item), {}
    for k, w in enumerate(layouts):
        counts = [bag(w[s : s + 59]) for s in range(len(w) - 58)]
        best = max(sum((b & c).values()) / sum((b | c).values()) for c in counts)
        want[k] = round(best, 9) if best >= 0.75 else 0.0
    example = other[:40] + item[1:7] + ["n1", "n2", "n3"] + item[7:58] + other[40:70]
    assert want[layouts.index(example)] == 0.774193548 and 0.0 in want.values()
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(layouts)], "doc_id long, text string")
    got = {r.doc_id: round(r.similarity, 9) for r in contamination(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == want
    # The item's first words at a document's end are no window of its size.
    short = [(1, " ".join(other[:60] + item[:46])), (2, " ".join(item[:46])), (3, " ".join(item[:46] + other[:13]))]
    got = {r.doc_id: (r.contaminated, round(r.similarity, 9)) for r in contamination(spark.createDataFrame(short, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: (False, 0.0), 2: (True, round(42 / 55, 9)), 3: (False, 0.0)}


def test_simhash_weighs_as_the_similarity_does(spark):
    """One n-gram repeated many times moves the fingerprint no further than the similarity of the bags allows."""
    from quillspark.llm.decontaminate import RADIUS, contamination

    items, docs, other = [], [], " ".join(f"o{k}" for k in range(30))
    for k in range(40):
        w = [f"i{k}_{x}" for x in range(504)]
        items.append((k, " ".join(w)))
        docs.append((k, f"{other} {' '.join(w[:434])} {'filler ' * 70}{other}"))
    bag = lambda t: Counter(zip(*[t.split()[x:] for x in range(5)]))
    a, b = bag(items[0][1]), bag(" ".join(docs[0][1].split()[30:534]))
    assert sum((a & b).values()) >= 0.75 * sum((a | b).values()) and RADIUS == 24 and max(b.values()) == 66
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [r.item_ids for r in got.orderBy("doc_id").collect()] == [[k] for k in range(40)]


def test_token_counts(docs, empty, odd):
    import public_tokenizers as p
    import tiktoken

    from quillspark.llm.token_counts import _coder, attribute, count_tokens, section_edges, token_spans

    path = p.path("byte_bpe_50k.tiktoken")
    for rule in ("first", "last", "most"):
        for r in count_tokens(docs, path, p.PATTERN, rule).collect():
            coder = _coder(open(path, "rb").read(), p.PATTERN)[0]
            assert isinstance(coder, tiktoken.Encoding)
            text = r.text or ""
            assert r.n_tokens == len(coder.encode_ordinary(text)) == sum(r.section_tokens)
            assert r.n_sections == len(r.section_tokens) == len(text.splitlines())
    coder, lengths = _coder(open(path, "rb").read(), p.PATTERN)
    text = "é\n\n\nb 日本 x"
    ids, starts, ends = token_spans(text, coder, lengths)
    assert starts[0] == 0 and ends[-1] == len(text) and (ends >= starts).all()
    edges = section_edges(text)
    assert edges.tolist() == [2, 3, 4, len(text)]
    # a token over characters 1 to 4 of sections that end at 2 and 5
    s, e, at = np.array([1]), np.array([4]), np.array([2, 5])
    assert [attribute(s, e, at, rule)[0][0] for rule in ("first", "last", "most")] == [0, 1, 1]
    assert attribute(s, e, at, "first")[1].tolist() == [True]
    # Every section's count against each token laid over the lines one by one.
    for r in count_tokens(docs, path, p.PATTERN, "most").collect():
        text, counts = r.text or "", []
        lines = text.splitlines(keepends=True)
        owner = [k for k, line in enumerate(lines) for _ in line]
        counts = [0] * len(lines)
        at, raw = 0, text.encode()
        for token in coder.encode_ordinary(text):
            n = int(lengths[token])
            first = len(raw[:at].decode(errors="ignore"))
            over = Counter(owner[first : max(len(raw[: at + n].decode(errors="replace")), first + 1)])
            counts[max(over, key=lambda k: (over[k], -k))] += 1
            at += n
        assert list(r.section_tokens) == counts
    assert count_tokens(empty, path, p.PATTERN).count() == 0 and count_tokens(odd, path, p.PATTERN).count() == 5


def _labelled(spark):
    r = random.Random(5)
    rows, labels = [], []
    for k in range(900):
        words = ["".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 8))) for _ in range(40)]
        bad, toxic = k % 5 == 0, k % 7 == 0
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        if toxic:
            text += " you zzinsult" if k % 2 else " zzgroup zzslur"
        rows.append((k, text))
        labels.append((k, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), labels


def test_classifiers_on_the_held_out_fold(spark, empty, odd):
    from quillspark.llm.quality import fit_quality, score_quality
    from quillspark.llm.toxicity import fit_toxicity, score_toxicity
    from quillspark.llm.training import held_out

    docs, labels, truth = _labelled(spark)
    quality, toxic = {k: q for k, q, _ in truth}, {k: t for k, _, t in truth}
    model, fm = fit_quality(docs, labels), fit_toxicity(docs, labels)
    unseen = [k for k in quality if zlib.crc32(str(k).encode()) % 3 == 1]
    marked = {r.doc_id for r in docs.filter(held_out(F.col("doc_id"))).collect()}
    assert marked == set(unseen)
    s = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    assert sum((s[k] >= 0.5) == quality[k] for k in unseen) / len(unseen) > 0.97
    s = {r.doc_id: r.score for r in score_toxicity(docs, fm).collect()}
    assert sum((s[k] >= 0.7) == toxic[k] for k in unseen) / len(unseen) > 0.97
    for score, m in ((score_quality, model), (score_toxicity, fm)):
        assert score(empty, m).count() == 0
        got = score(odd, m).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = fit_quality(docs, labels.limit(0))
    assert {round(r.score, 6) for r in score_quality(odd, none).collect()} == {0.5}
    assert {round(r.score, 6) for r in score_toxicity(odd, fit_toxicity(docs, labels.limit(0))).collect()} == {0.5}


def test_factorization_machine_learns_an_interaction():
    from quillspark.llm.toxicity import fit

    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        rows.append(np.array(sorted({int(x) for x in rng.integers(10, 500, 12)} | ({1} if a else set()) | ({2} if b else set()))))
        y.append(float(a and b))
    model = fit(rows, np.array(y), 512)
    assert model.score(np.array([1, 2])) > 0.7 > 0.3 > max(model.score(np.array([1])), model.score(np.array([2])), model.score(np.array([], np.int64)))


def test_factorization_machine_learns_an_interaction_of_terms_that_tell_nothing_alone():
    from quillspark.llm.toxicity import fit

    rng = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted({int(x) for x in rng.integers(10, 500, 12)} | ({1} if a else set()) | ({2} if b else set()))))
        y.append(float(a == b))
    model = fit(rows, np.array(y), 512)
    assert min(model.score(np.array([1, 2])), model.score(np.array([], np.int64))) > 0.9 > 0.1 > max(model.score(np.array([1])), model.score(np.array([2])))


def test_scores_against_the_explicit_sum(spark):
    """The machine's margin is the sum over all pairs, and the scores of a table are those of its texts."""
    from quillspark.llm.toxicity import FactorizationMachine, TermHasher, score_toxicity

    rng = np.random.default_rng(8)
    model = FactorizationMachine(0.3, rng.normal(0, 0.3, 64).astype(np.float32), rng.normal(0, 0.3, (64, 4)).astype(np.float32))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 99, int(rng.integers(0, 30)))) for _ in range(20)] + [None]
    hasher = TermHasher(64)
    for text in texts:
        t = hasher.of(text or "")
        pairs = sum(float(model.factors[a] @ model.factors[b]) for k, a in enumerate(t) for b in t[:k])
        assert abs(model.margin(t) - (0.3 + float(model.linear[t].sum()) + pairs)) < 1e-4
    wide = FactorizationMachine(0.3, np.resize(model.linear, 1 << 18), np.resize(model.factors, (1 << 18, 4)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, Text string")
    for r in score_toxicity(docs, wide).collect():
        assert abs(r.score - wide.score(TermHasher().of(r.Text or ""))) < 1e-6


def test_compiled_rules_against_rules_in_python(spark, docs):
    """The compiled column gives what adding up the rules that hold gives; columns of clashing names stay."""
    from quillspark.llm.quality import RuleEnsemble, score_quality, with_statistics

    model = RuleEnsemble(0.2, ((0.7, (("word_chars", True, 5.5),)), (-1.1, (("distinct", False, 0.9), ("upper", False, 0.1))), (0.4, (("log_chars", True, 3.0), ("stops", False, 0.2)))))
    clash = docs.withColumns({"stat_words": F.lit("a"), "stat_upper": F.lit("b"), "stat_body": F.lit("c"), "score": F.lit("d")})
    stats, names = with_statistics(docs.withColumn("body", F.coalesce("text", F.lit(""))))
    want = {}
    for r in stats.collect():
        total = 0.2
        for w, conditions in model.rules:
            if all((r[names[k]] > at) == above for k, above, at in conditions):
                total += w
        want[r.doc_id] = 1 / (1 + np.exp(-total))
    rows = score_quality(clash, model).collect()
    assert len(rows) == len(want) and len(set(want.values())) > 2
    for r in rows:
        assert abs(r.score - want[r.doc_id]) < 1e-9 and (r.stat_words, r.stat_upper, r.stat_body) == ("a", "b", "c")


@pytest.mark.parametrize("options", [{}, {"group": 2, "often": 10**9, "cuts": 3}, {"group": 40, "often": 10**9, "cuts": 17}])
def test_jaccard_components(docs, options):
    from quillspark.llm.jaccard_join import near_duplicate_groups

    sets = {}
    for k, t, *_ in corpus():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {k: k for k in sets}
    moved = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                moved = True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_groups(docs, **options).collect()}
    assert got == {k: (len(s), label[k]) for k, s in sets.items()}


def test_jaccard_edges(empty, odd):
    from quillspark.llm.jaccard_join import near_duplicate_groups

    assert near_duplicate_groups(empty).count() == 0
    assert len(near_duplicate_groups(odd).collect()) == 5


@pytest.mark.parametrize("options", [{"often": 10**9}, {}])
def test_jaccard_components_of_common_grams(spark, monkeypatch, options):
    """Large families whose members are similar, nearly similar or linked by chains, with own words and without; large groups in parts."""
    from quillspark.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "SQUARE", 8)
    monkeypatch.setattr(jaccard_join, "LEADERS", 2)
    r = random.Random(9)
    fresh = iter(range(10**6))
    own = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    texts = []
    for family in range(6):
        base = own(60)
        for _ in range(40):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(60)] = r.choice(own(1) + [f"c{family}"])
            cut = r.randint(0, 14) if family % 2 else 0
            texts.append(w[cut:] + own(r.randint(0, 22) if family > 2 else 0))
        if family > 3:  # two passages, one after the other
            other = own(30)
            texts += [base[:30] + other + own(r.randint(0, 6)) for _ in range(20)]
    r.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    label = list(range(len(sets)))

    def top(v):
        while label[v] != v:
            v = label[v]
        return v

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                u, v = top(a), top(b)
                label[max(u, v)] = min(u, v)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {row.doc_id: row.component_id for row in jaccard_join.near_duplicate_groups(docs, group=5, **options).collect()}
    assert got == {k: top(k) for k in range(len(sets))} and len(set(got.values())) > 20


@pytest.mark.parametrize("share", [1 / 512, 0, 0.004, 1])
def test_passages_against_all_windows(docs, share):
    from quillspark.llm.passage_dedup import drop_repeated_passages

    words = {k: (t or "").encode().split() for k, t, *_ in corpus()}
    first = {}
    for k, w in sorted(words.items()):
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), k)
    got = {r.doc_id: r for r in drop_repeated_passages(docs, share=share).collect()}
    for k, w in words.items():
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < k for q in range(p, p + 13)}
        assert (got[k].n_words, got[k].n_removed) == (len(w), len(gone)), k
        assert got[k].kept == b" ".join(x for q, x in enumerate(w) if q not in gone).decode()


def test_hot_anchors_leave_their_fragment(spark):
    """However many anchors a task packs at a time, the same segments are repeated; a line that all share brings a fragment a few marks."""
    from quillspark.llm.anchors import repeated_spans, word_codes

    r = random.Random(12)
    word = lambda: f"w{r.randrange(5000)}"
    licence = " ".join(word() for _ in range(30))
    rows = [(k, bytearray(f"{' '.join(word() for _ in range(r.randint(0, 40)))} {licence} {' '.join(word() for _ in range(5))}".encode())) for k in range(300)]
    rows += [(1000 + k, bytearray((" ".join(["again and"] * 20) + f" {k}").encode())) for k in range(3)] + [(2000 + k, bytearray(" ".join(word() for _ in range(50)).encode())) for k in range(50)]
    docs = spark.createDataFrame(rows, "rid long, body binary").repartition(3)
    found = {}
    for pack in (1 << 20, 400, 1):
        got = repeated_spans(docs, word_codes, 5, 13, pack=pack)
        found[pack] = sorted((x.rid, s.s, s.n, s.key, s.twice) for x in got.collect() for s in x.spans)
    assert found[1 << 20] == found[400] == found[1] and len({x[0] for x in found[1]}) >= 303
    codes = {k: word_codes([bytes(b)])[0] for k, b in rows}
    seen = Counter(tuple(c[i : i + 13]) for c in codes.values() for i in range(len(c) - 12))
    covered = {(rid, i) for rid, s, n, *_ in found[1] for i in range(s, s + n)}
    assert covered >= {(k, i) for k, c in codes.items() for i in range(len(c) - 12) if seen[tuple(c[i : i + 13])] > 1}


def test_nodes_of_a_suffix_tree():
    """Every run of suffixes that share so many words is one node, and no two nodes share them."""
    from quillspark.llm.passage_dedup import common_prefixes, deep_nodes

    rng = np.random.default_rng(4)
    for depth in (1, 3, 5):
        rows = np.array(sorted(map(tuple, rng.integers(0, 3, (200, 5)))), np.uint64)
        shared = common_prefixes(rows)
        for k in range(1, 200):
            want = 0
            while want < 5 and rows[k, want] == rows[k - 1, want]:
                want += 1
            assert shared[k] == want
        node = deep_nodes(shared, depth)
        for k in range(200):
            assert node[k] == next(j for j in range(200) if (rows[j, :depth] == rows[k, :depth]).all())
    assert not len(deep_nodes(np.zeros(0), 2))


def test_passage_edges(empty, odd):
    from quillspark.llm.passage_dedup import drop_repeated_passages

    assert drop_repeated_passages(empty, digests=True).count() == 0
    assert drop_repeated_passages(odd, digests=True).count() == 5


def test_passages_with_null_and_repeated_ids(spark):
    """Ids keep their order whatever other rows hold; equal and null ones follow each other as rows do."""
    from quillspark.llm.passage_dedup import drop_repeated_passages

    r = random.Random(6)
    p, q = (" ".join(f"{x}{r.randrange(1000)}" for _ in range(20)) for x in "pq")
    for rows in ([(5, p), (3, p), (None, "x")], [(5, p), (3, p), (5, q), (None, p), (None, q), (9, f"{q} {p}"), (3, None)], [(2, p), (2, p), (1, f"a {p} b")]):
        order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
        first, want = {}, []
        for k in order:
            w = (rows[k][1] or "").split()
            grams = [tuple(w[i : i + 13]) for i in range(len(w) - 12)]
            gone = {i + j for i, g in enumerate(grams) if first.setdefault(g, k) != k for j in range(13)}
            want.append((rows[k][0], len(w), len(gone)))
        got = drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), digests=True).collect()
        assert sorted(map(repr, ((x.doc_id, x.n_words, x.n_removed) for x in got))) == sorted(map(repr, want))


def _collision() -> tuple[str, str]:
    """Two words of 1,024 letters whose sums of powers are equal modulo 2**64 for every odd base."""
    bits = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    return bits, bits.translate(str.maketrans("ab", "ba"))


def test_long_words_are_told_apart(spark):
    from quillspark.llm.jaccard_join import near_duplicate_groups
    from quillspark.llm.passage_dedup import drop_repeated_passages

    one, two = _collision()
    same = " ".join(["w"] * 12)
    docs = spark.createDataFrame([(1, f"{same} {one}"), (2, f"{same} {two}"), (3, f"a b c d {one}"), (4, f"a b c d {two}"), (5, f"a b c d {one}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in drop_repeated_passages(docs).collect()} == dict.fromkeys(range(1, 6), 0)
    assert {r.doc_id: r.component_id for r in near_duplicate_groups(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, t, "en", "s", len(t or "")) for k, t, *_ in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = {k: t for k, t, *_ in corpus()}
    item = " ".join(texts[60].split("\n")[1].split(" ")[:60])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    docs, columns, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), None, []
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, str(tmp_path))
        columns = columns or docs.columns
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    left = {r.doc_id for r in docs.collect()}
    assert counts[0] == len(rows)  # without labels nothing is rejected
    assert counts[1] == len({t or "" for t in texts.values()})
    assert not left & set(range(57, 63)) and sum(k in left for k in range(40, 57)) == 1
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} == left and "ids" in final.columns


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op3_exact_dedup", "op8_jaccard_join", "op9_passage_dedup"])
def test_queries_agree_with_their_sql(spark, docs, tmp_path, name):
    import duckdb

    from quillspark.llm import queries

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[k] for k in want.columns) for r in got.collect()) == sorted(want.fetchall())
