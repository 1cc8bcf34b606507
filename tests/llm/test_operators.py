"""Operators on small fixtures: edge rows, and brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from qassay.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, pseudonyms, quality_rules, token_counts, toxicity, warc_revisits
from qassay.llm.components import connected_components
from qassay.llm.queries import tokenizer_definition
from qassay.llm.words import batch_words

SCHEMA = "doc_id long, text string, row string, k1 string, _kept string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
EDGES = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (None, None), (4, LONG), (5, "  \n\t \n"), (6, "x" * 5000)]


def frame(spark, rows):
    """Rows with further columns whose names clash with those the operators use."""
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def definition():
    return tokenizer_definition("byte_bpe_50k.json")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def test_word_hashes_name_words():
    texts = ["Ab é9_ab\0AB", "", "ab " * 3, "ß" * 600_000 + " ab"]
    hashes, offsets = batch_words([t.encode() for t in texts])
    words = [w for t in texts for w in words_of(t)]
    assert np.diff(offsets).tolist() == [len(words_of(t)) for t in texts]
    assert len(set(words)) == len(set(hashes.tolist())) == len(set(zip(words, hashes.tolist(), strict=True)))


def test_decontamination_against_brute_force(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = [(7, item), (8, "short Item"), (9, None), (None, item), (None, "only without id"), (10, "short item"), (11, "...")]
    docs = [(20, f"x {item.upper()} y"), (21, "short, item! and " + " ".join(item.split()[:9])), (22, "item short"), (23, "only without id"), *EDGES]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {(i, tuple(w[p : p + 10])) for i, t in items for w in [words_of(t)] if w for p in range(max(1, len(w) - 9))}
    for block in (200_000, 1):
        got = decontaminate.find_contamination(frame(spark, docs), bench, block_windows=block).collect()
        want = Counter()
        for doc_id, text in docs:
            w, hit, found = words_of(text), set(), set()
            for i, k in windows:
                for p in range(len(w) - len(k) + 1):
                    if tuple(w[p : p + len(k)]) == k:
                        hit.update(range(p, p + len(k)))
                        found.add(None if i is None else str(i))
            want[(doc_id, len(w), len(hit), tuple(sorted(found, key=lambda x: (x is None, x))))] += 1
        assert Counter((r.doc_id, r.n_words, sum(s.last - s.first + 1 for s in r.spans), tuple(r["items"])) for r in got) == want
    assert decontaminate.find_contamination(frame(spark, docs), bench.limit(0)).filter(F.size("items") > 0).count() == 0
    assert decontaminate.find_contamination(frame(spark, []), bench).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)] + [(300, 301 + i) for i in range(50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 300 for i in range(300, 351)}


def jaccard_brute(rows, k=5):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    group, links = list(range(len(rows))), [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    return group, links


@pytest.mark.parametrize("limit,block", [(256, 1500), (4, 7)])
def test_jaccard_join_against_brute_force(spark, limit, block):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 5)):
            w[p] = f"v{rng.integers(0, 500)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, "a b c d e f"), (201, "A, b c d e f!"), (202, "a b c"), (203, "a b c"), (204, ""), (205, None), (206, LONG), (207, LONG + " end")]
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(frame(spark, rows), bucket_limit=limit, block_sets=block).collect()}
    group, links = jaccard_brute(rows)
    assert {d: got[d].n_links for d, _ in rows} == {rows[i][0]: n for i, n in enumerate(links)}
    assert {d: got[d].class_id for d, _ in rows} == {rows[i][0]: rows[g][0] for i, g in enumerate(group)}


def shingles_of(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def links_by_index(texts):
    """Number of other rows with a shingle similarity of 0.8 or more, through an index of shingles."""
    sets, index, links = [shingles_of(t) for t in texts], {}, [0] * len(texts)
    for i, own in enumerate(sets):
        shared = Counter(j for g in own for j in index.get(g, ()))
        for j, n in shared.items():
            if 5 * n >= 4 * (len(own) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
        for g in own:
            index.setdefault(g, []).append(i)
    return links


def test_jaccard_links_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, links_by_index(list(texts.values())), strict=True))
    for limit in (4096, 8):
        got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(docs, bucket_limit=limit).collect()}
        assert got == want


def test_jaccard_recall_on_skewed_rows(spark):
    """A passage that half of the rows share, a large group of near copies of one text, and pairs among the sharing rows."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(4000)]
    passage, base = rng.choices(vocabulary, k=60), rng.choices(vocabulary, k=120)
    rows = []
    for _ in range(150):
        own = rng.choices(vocabulary, k=35)
        rows.append(passage + own)
        rows.append(passage + own[:-1] + [rng.choice(vocabulary)])
    for _ in range(200):
        near = list(base)
        for _ in range(rng.randint(1, 4)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        rows.append(near)
    texts = [" ".join(r) for r in rows]
    want = links_by_index(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(docs, bucket_limit=16).collect()}
    found = sum(got.values()) / sum(want)
    assert sum(want) > 2000 and found >= 0.999 and all(got[i] <= n for i, n in enumerate(want))


def test_jaccard_runs_keep_the_recall():
    slack = jaccard_join.least_slack(0.8, 0.9999)
    assert jaccard_join.missed(0.8, slack, 0, 1) < 1e-5
    for depth in range(1, 13):
        runs = jaccard_join.runs_needed(0.8, 0.9999, slack, depth)
        assert jaccard_join.missed(0.8, slack, depth, runs) <= 1e-4 < jaccard_join.missed(0.8, slack, depth, runs - 1)
    with pytest.raises(ValueError):
        jaccard_join.runs_needed(0.8, 0.9999, 0.13, 1)


def test_jaccard_join_edge_rows(spark):
    got = jaccard_join.jaccard_join(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    assert sorted(r.n_links for r in got if r.class_id is None and r.n_links) == [2, 2, 2]
    assert jaccard_join.jaccard_join(frame(spark, [])).count() == 0


def test_line_dedup_edges_and_first(spark):
    rows = [(i, f"Shared \nown {i}\n\n shared\t") for i in range(10)] + EDGES
    docs = frame(spark, rows)
    for keep_first, kept in ((False, 0), (True, 1)):
        got = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs, min_docs=10, keep_first=keep_first)).collect()
        assert len(got) == len(rows)
        shared = [r for r in got if r.text and r.text.startswith("Shared")]
        assert sum(r["_n_dropped"] for r in shared) == 20 - kept
        assert all(r["_n_dropped"] == 0 for r in got if r not in shared)
    assert line_dedup.drop_bitmaps(frame(spark, [])).count() == 0


def test_quality_counts_on_edges(spark):
    got = {r.doc_id: r for r in quality_rules.apply_rules(frame(spark, [*EDGES, (9, "a b c a b c\nx\nx\n\n")])).collect()}
    assert (got[9].n_words, got[9].n_repeat_words, got[9].n_dup_lines, got[9].word_chars) == (8, 6, 1, 8)
    assert not any(got[d].kept for d in (1, 2, 3, 5, 6)) and got[4].base_failed


def test_packing_round_trip_and_optimum(spark, definition):
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(definition)
    rows = [*EDGES, (10, "A. B! <|endoftext|>\n  漢字"), (11, "word " * 3000)]
    got = packing.pack(frame(spark, rows).coalesce(1), definition, public_tokenizers.PATTERN).collect()
    want = Counter((d, tuple([*own.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in rows)
    texts, at = Counter(), []
    for r in got:
        if r.start == 0:
            at = []
        at += np.frombuffer(r.ids, dtype="<u4").tolist()
        if len(at) == r.doc_tokens:
            texts[(r.doc_id, tuple(at))] += 1
    assert texts == want
    rng = np.random.default_rng(2)
    for _ in range(20):
        doc_ends = np.unique(rng.integers(1, 400, 8))
        positions, kinds = packing.cut_points(doc_ends, np.unique(rng.integers(1, doc_ends[-1] + 1, 20)), 64)
        cost = np.array([0, 2, 9])[kinds]
        cuts = packing.best_cuts(positions, cost, 64)
        best = [0] + [None] * (len(positions) - 1)
        pad = lambda n: 0 if n & (n - 1) == 0 else 64 - n
        for j in range(1, len(positions)):
            best[j] = min(best[i] + pad(int(positions[j] - positions[i])) for i in range(j) if positions[j] - positions[i] <= 64) + int(cost[j])
        sizes = np.diff(positions[cuts])
        assert sum(pad(int(n)) for n in sizes) + cost[cuts[1:]].sum() == best[-1] and sizes.max() <= 64


def test_packing_cuts_at_ends_of_documents_and_sentences(spark, definition):
    rng = np.random.default_rng(12)
    sentence = lambda: " ".join(f"w{n}" for n in rng.integers(0, 900, rng.integers(3, 25))) + "."
    rows = [(i, " ".join(sentence() for _ in range(rng.integers(1, 80)))) for i in range(300)] + [(300, "word " * 20_000)]
    got = packing.pack(frame(spark, rows).coalesce(1), definition, public_tokenizers.PATTERN).collect()
    last = {r.sequence_id: r for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))}
    sizes = [r.offset + r.length for r in last.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    inside = [r for r in last.values() if r.ends_at == "inside"]
    # Only the text without sentences is cut inside, and padding stays small.
    assert {r.doc_id for r in inside} == {300} and padding < 0.02 * sum(sizes)
    assert all((r.start + r.length == r.doc_tokens) == (r.ends_at == "document") for r in got)


def test_packing_special_tokens_and_invalid_bytes(spark, definition):
    from tokenizers import Tokenizer

    texts = spark.sql("SELECT 1L AS doc_id, 'a <|endoftext|> b' AS text UNION ALL SELECT 2L, cast(unhex('61FF6220') AS string)")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(texts, definition, public_tokenizers.PATTERN).collect()}
    plain = Tokenizer.from_str(definition)
    assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in ((1, "a <|endoftext|> b"), (2, "a\ufffdb "))}
    assert 50256 in got[1]


def test_piece_automaton_is_greedy(spark):
    pieces = [b" a", b" ab", b" abcd", b"bc", b"bcd", b"cde", b"ef", b"d", b"dee"]
    automaton, known = token_counts.PieceAutomaton(pieces), {*pieces, *(bytes([b]) for b in range(256))}
    rng = np.random.default_rng(4)
    for _ in range(500):
        word = bytes(rng.choice(list(b"abcdef"), rng.integers(1, 12)).tolist())
        rest, n = b" " + word, 0
        while rest:
            size = max(s for s in range(1, len(rest) + 1) if rest[:s] in known)
            rest, n = rest[size:], n + 1
        assert automaton.count(word) == n


def test_token_counts_on_edges(spark, definition):
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(frame(spark, EDGES), definition).collect()}
    assert got[1] == got[2] == got[5] == (0, 0) and got[3][0] == 3 and got[4][0] == 30_000 and got[6][1] > 100


def test_line_dedup_hot_lines(spark, monkeypatch):
    rows = [(i, "hot\nother" if i % 2 else f"hot\nown {i}") for i in range(40)] + [(None, "hot"), (None, None)]
    for hot_lines in (1, 3, 1000):  # none hot, one hot, both hot
        monkeypatch.setattr(line_dedup, "HOT_LINES", hot_lines)
        for keep_first in (False, True):
            docs = spark.createDataFrame(rows, "doc_id long, text string")
            got = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs, keep_first=keep_first)).collect()
            firsts = {(None, "hot"): "hot", (1, "hot\nother"): "other"} if keep_first else {}
            want = [(i, firsts.get((i, t), "" if i is None or i % 2 else f"own {i}")) for i, t in rows]
            assert Counter((r.doc_id, r["_kept"]) for r in got) == Counter(want)


def test_language_sample_holds_distinct_texts(spark):
    copies = [("en", "the same words of a copied text") for _ in range(3000)]
    others = [("en", f"the words of text number {i} and {i * 7}") for i in range(40)] + [("de", f"die Wörter des Textes {i}") for i in range(40)]
    rows = spark.createDataFrame(copies + others, "lang string, text string")
    net = language_id.fit(rows, per_language=20)
    assert net.languages == ["de", "en"]
    docs = spark.createDataFrame([(1, "die Wörter"), (2, "the words of a text"), (3, "² ½ Ⅷ 12_"), (4, "日本")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, net).collect()}
    assert got[1] == "de" and got[2] == "en" and got[3] == "und" and got[4] != "und"


def test_models_on_edges(spark):
    docs, none = frame(spark, EDGES), frame(spark, [])
    labels = spark.createDataFrame([(3, 0), (4, 1), (1, None)], "doc_id long, toxic int")
    for net in (toxicity.fit(docs, labels), toxicity.fit(none, labels.limit(0))):
        got = toxicity.score_toxicity(docs, net).collect()
        assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
        assert toxicity.score_toxicity(none, net).count() == 0
    for net in (language_id.fit(docs.withColumn("lang", F.when(F.col("doc_id") > 3, "en").otherwise("de"))), language_id.fit(none.withColumn("lang", F.lit("en")))):
        got = language_id.identify(docs, net).collect()
        assert len(got) == len(EDGES) and {r.lang_pred for r in got if r.doc_id in (1, 2, 5)} == {"und"}
        assert language_id.identify(none, net).count() == 0


def test_toxicity_learns(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(240):
        w = [f"w{n}" for n in rng.integers(0, 60, 150)]
        if i % 2:
            w[rng.integers(10, 140)] = w[rng.integers(10, 140)] = "scoundrel"
        rows.append((i, " ".join(w), i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.fit(docs, docs.filter("doc_id < 160").select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, net).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(i % 2) for i in range(160, 240)]) > 0.8


def test_gradient_of_the_gated_network():
    net = toxicity.GatedNet(window=5, hidden=3, width=2, buckets=64)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    tokens, rows, y = ["", "one", "two", "three"], np.array([[1, 2, 3, 0, 0], [3, 3, 1, 2, 1]]), np.array([1.0, 0.0])
    feats, found = net.features(tokens), {}

    class Catch:
        def step(self, grads, scale):
            found.update(grads)

    def loss():
        logit = net.forward(net._split(net.embed(*feats) @ net.weights["inputs"] + net.weights["input_bias"]), rows)[0]
        return np.mean(np.log1p(np.exp(logit)) - y * logit)

    net.learn(Catch(), feats, rows, y, 1.0)
    rng = np.random.default_rng(0)
    for name, grad in found.items():
        flat = np.flatnonzero(np.abs(grad) > 1e-4)
        for i in rng.choice(flat, min(4, len(flat)), replace=False):
            place, size = np.unravel_index(i, grad.shape), 1e-3
            kept = net.weights[name][place]
            net.weights[name][place] = kept + size
            up = loss()
            net.weights[name][place] = kept - size
            down = loss()
            net.weights[name][place] = kept
            assert abs((up - down) / (2 * size) - grad[place]) < 2e-2 * abs(grad[place]) + 2e-4, name


def feistel_string(value, key, kind):
    """The string network in plain Python."""
    middle = -(-len(value) // 2)
    a, b = value[:middle], value[middle:]
    for n in range(pseudonyms.ROUNDS):
        digest, out = hashlib.sha256(f"{key}|{kind}|{n}|{b}".encode()).hexdigest(), ""
        for i, c in enumerate(a):
            move = int(digest[i % 16 * 4 : i % 16 * 4 + 4], 16)
            for first, size in (("0", 10), ("a", 26), ("A", 26)):
                if c.isascii() and ord(first) <= ord(c) < ord(first) + size:
                    c = chr((ord(c) - ord(first) + move) % size + ord(first))
                    break
            out += c
        a, b = b, out
    return a + b


def test_pseudonyms(spark):
    rows = [(11, "a 4111111111111111 b 4111111111111112"), (12, "4111-1111-1111-1111? x.y7@m.org, +1 (017) 555-7713"), (13, "2024-02-30 29.02.2023 300.1.1.1"), (14, "29.02.2024 8.8.8.8 123-45-6789"), *EDGES]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(frame(spark, rows), "key").collect()}
    body = feistel_string("411111111111111", "key", "card")
    assert got[11].text.startswith(f"a {body}") and got[11].text.endswith(" b 4111111111111112") and [f.kind for f in got[11].found] == ["card"]
    assert [f.replacement for f in got[12].found][1:] == [feistel_string("x.y7", "key", "email") + "@m.org", "+1" + feistel_string(" (017) 555-7713", "key", "phone")]
    assert got[13].found == []
    assert [f.kind for f in got[14].found] == ["date", "ip", "ssn"]
    days = spark.range(146097).select(pseudonyms.pair_feistel(F.col("id"), "k", "date", 189, 773).alias("v"))
    assert days.distinct().count() == 146097
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise(frame(spark, []), "")
    assert pseudonyms.pseudonymise(frame(spark, []), "k").count() == 0


def test_warc_revisits_on_edges(spark):
    schema = "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>, slice string"
    rows = [
        (1, "response", "http://www.A.org:80/x?b=2&a=1&utm_id=3#f", 10, 'W/"t"', "m", {"ETag": "t", "Server": "s", "Date": "1"}, ""),
        (2, "revisit", "https://a.org/x?a=1&b=2", 11, '"t"', None, {"Date": "2", "Server": "no"}, ""),
        (3, "revisit", "https://a.org/x?a=1&b=2", 10, '"t"', None, None, ""),
        (4, "revisit", "https://a.org/x?a=1&b=2", 10**9, None, "m", None, ""),
        (5, "revisit", "https://a.org/x?a=1&b=2", 12, None, None, None, ""),
        (6, "revisit", "https://a.org/x?a=1&b=2", 12, '"u"', "m", None, ""),
        (7, "revisit", None, 12, '"t"', None, None, ""),
        (8, "revisit", "https://a.org/x?a=1&b=2", None, '"t"', None, None, ""),
        (9, "request", "https://a.org/x", 12, None, None, None, ""),
    ]
    records = spark.createDataFrame(rows, schema)
    got = {r.record_id: r for r in warc_revisits.resolve_revisits(records).collect()}
    assert {k: r.verdict for k, r in got.items()} == {2: "resolved", 3: "orphan", 4: "resolved", 5: "no_validator", 6: "mismatch", 7: "orphan", 8: "orphan"}
    assert got[2].headers == {"etag": "t", "server": "s", "date": "2"} and got[4].matched_id == 1
    assert warc_revisits.resolve_revisits(records.limit(0)).count() == 0


def test_warc_revisits_of_a_hot_url_with_a_stray_time(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["response", "revisit", "revisit"]), "http://a.org/" if i % 3 else f"http://b.org/{i % 50}", rng.randrange(400), "t", None) for i in range(3000)]
    rows += [(5000, "response", "http://a.org/", -(10**15), "t", None), (5001, "revisit", "http://a.org/", 10**15, "t", None), rows[0], rows[1]]
    got = warc_revisits.resolve_revisits(spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, etag string, last_modified string").withColumn("headers", F.lit(None).cast("map<string,string>")))
    want = Counter()
    for record, kind, url, ts, _, _ in rows:
        if kind == "revisit":
            earlier = [(r[3], r[0]) for r in rows if r[1] == "response" and r[2] == url and r[3] < ts]
            want[record, max(earlier)[1] if earlier else None] += 1
    assert Counter((r.record_id, r.matched_id) for r in got.collect()) == want


def test_ids_crc_is_little_endian(spark):
    ids = np.array([1, 50256], dtype="<u4").tobytes()
    got = spark.createDataFrame([(ids,)], "ids binary").select(F.crc32("ids")).first()[0]
    assert got == zlib.crc32(ids)
