"""The text operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinroute.llm import chat_format, decontaminate, language_id, maxent_lm, packing, quality_rules, queries, simhash_dedup, substring_dedup, tables, toxicity, url_filters, words

DOC = "doc_id long, text string"
#: Rows that every operator must stand: nulls, empty, spaces, repeats of an id, odd characters.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "no id here"), (5, "é ß \x1c\x85 x"), (6, "a " * 3000), (7, "\U0001f600 ok")]


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def odd(spark):
    """Odd rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    out = frame(spark, ODD)
    for name in ("n_words", "n_removed", "start", "_start", "row", "kept", "score", "fp", "cell", "others", "verdict", "lang", "key"):
        out = out.withColumn(name, F.lit("x"))
    return out


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_word_split_and_spans():
    texts = ["one two", None, "", "  x\ty\x0bz ", "two", "é ü q"]
    w = words.split(pa.array(texts))
    got = [[bytes(w.data[a:b]) for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first, w.first[1:])]
    assert got == [(t or "").encode().split() for t in texts]
    flat = [x for g in got for x in g]
    assert (w.hash[flat.index(b"two")] == w.hash[len(flat) - 1 - flat[::-1].index(b"two")]) and len(set(w.hash.tolist())) == len(set(flat))
    assert len(words.split(pa.array([], pa.string())).start) == 0


def test_slices_are_whole():
    batch = pa.record_batch({"text": ["x" * n for n in (5, 0, 50, 1, 1, 1)]})
    parts = list(words.slices(batch, "text", 10))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist() and max(p.num_rows for p in parts) == 3


# ---- chat formatting


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*chat_format.Template().controls(), "\\", "<", "|", "a", "\n", "[", "INST]", "end|>"]), max_size=8).map("".join), max_size=4))
def test_escape_is_reversible(texts):
    t = chat_format.Template()

    def esc(x):
        x = x.replace("\\", "\\\\")
        for c in t.controls():
            x = x.replace(c, c[0] + "\\" + c[1:])
        return x

    import re

    for x in texts:
        assert not any(c in esc(x) for c in t.controls())
        assert re.sub(r"\\(\\?)", r"\1", esc(x)) == x


def test_chat_round_trip_and_machine(spark):
    from pyspark.sql import functions as F

    said = [
        (1, 1, "assistant", "b\\ </s>"), (1, 0, "user", "<|turn|>user<|text|>"), (2, 0, "assistant", "x"), (3, 0, "system", None), (3, 1, "user", "q"),
        (3, 2, "assistant", "[INST]"), (4, 0, None, None), (None, 0, "user", "u"), (5, 0, "user", "t"), (5, 0, "user", "t"),
    ]
    turns = frame(spark, said, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat_format.format_chats(turns)
    rows = {r["conv_id"]: r for r in out.select("*", chat_format.parse(F.col("formatted")).alias("back")).collect()}
    want = defaultdict(list)
    for c, k, role, text in sorted(said, key=lambda x: (x[0] or 0, x[1])):
        want[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["back"]] for c, r in rows.items()} == dict(want)
    assert [rows[c]["valid"] for c in (1, 2, 3, 4, 5)] == [True, False, True, False, False]
    assert rows[5]["bad_turn"] == 1 and rows[2]["bad_turn"] == 0
    assert [s["text"] for s in rows[3]["segments"] if s["loss"]] == ["[\\INST]"]
    assert chat_format.format_chats(turns.limit(0)).count() == 0


# ---- packing


def cut_lengths(total, capacity):
    first = (total - 1) % capacity + 1
    return [first, *[capacity] * ((total - first) // capacity)]


def test_packing_is_exact_and_tight(spark, sf):
    from tokenizers import Tokenizer
    import public_tokenizers

    docs = odd(spark).unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    got = packing.pack(tables.materialise(packing.pieces(docs))).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, n in enumerate(cut_lengths(len(ids), 1024)):
            want[(r["doc_id"], k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))] += 1
            at += n
    assert Counter((None if pd.isna(i) else int(i), k, s, n, c) for i, k, s, n, c in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 1024 and (g["length"].cumsum() - g["length"] == g["offset"]).all()
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 1024) + 2


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=12))
def test_plan_covers_the_histogram(histogram):
    configs = packing.plan(histogram, 60)
    made = Counter()
    for config, n in configs.items():
        assert sum(config) <= 60 and n > 0
        for size in config:
            made[size] += n
    assert made == Counter(histogram)
    assert sum(configs.values()) <= 1.05 * sum(packing.best_fit(Counter(histogram), 60).values()) + 1


def test_plan_is_near_the_bound():
    """Within 1 % of the volume bound and of plain best-fit decreasing, which is no part of the plan but for its last rest."""
    rng = np.random.default_rng(2)
    for n in (2_000, 40_000):
        histogram = Counter(np.minimum(rng.lognormal(5.6, 1, n).astype(int) + 1, 1024).tolist())
        used = sum(packing.plan(dict(histogram)).values())
        assert used <= 1.01 * -(-sum(k * v for k, v in histogram.items()) // 1024)
        assert used <= 1.01 * sum(packing.best_fit(histogram, 1024).values())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 3), st.integers(0, 9)), min_size=1, max_size=6, unique_by=lambda x: x[0]))
def test_price_is_the_bounded_knapsack(found):
    lengths, counts, weights = (np.array(x) for x in zip(*sorted(found), strict=True))
    value, configs = packing.price(weights.astype(float), lengths, counts, 40)
    assert ((configs @ lengths <= 40) & (configs <= counts).all(axis=1)).all() and np.allclose(configs @ weights, value)
    sums = {0: 0}
    for size, n, w in zip(lengths.tolist(), counts.tolist(), weights.tolist(), strict=True):
        sums = {t: max(sums.get(t - k * size, -1) + k * w for k in range(n + 1) if t - k * size in sums) for t in {x + k * size for x in sums for k in range(n + 1)} if t <= 40}
    assert abs(value.max() - max(sums.values())) < 1e-6


def test_encoder_equals_the_tokenizer_file():
    e = packing.Encoder()
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.fillna("").tolist()
    for text in ["It's  fine.\n\n x", "É ça ß 123  45", "<|endoftext|> a", "日本 語", "tab\t\tq ", "’quote’ – dash", *texts]:
        assert e.ids(text).tolist() == e._full.encode(text, add_special_tokens=False).ids


# ---- substring dedup


def brute_substrings(rows, window=20):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def passages(seed, n=60):
    rng = np.random.default_rng(seed)
    vocab = [f"w{k}" for k in range(40)]
    shared = [list(rng.choice(vocab, int(k))) for k in rng.integers(18, 45, 5)]
    rows = []
    for i in range(n):
        body = list(rng.choice(vocab[:6] if i % 7 == 0 else vocab, int(rng.integers(0, 80))))
        for _ in range(int(rng.integers(0, 3))):
            p = shared[int(rng.integers(0, 5))]
            at = int(rng.integers(0, len(body) + 1))
            body[at:at] = p[int(rng.integers(0, 4)) :]
        rows.append((i, " ".join(map(str, body))))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, "z " * 100), (n + 3, None), (n + 4, "")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_equal_brute_force(spark, seed):
    rows = passages(seed)
    got = substring_dedup.dedup(frame(spark, rows).repartition(5)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in got} == brute_substrings(rows)


def test_batches_equal_one_batch(spark):
    rows = passages(3)
    docs = frame(spark, rows)
    index = substring_dedup.FingerprintIndex()
    texts = substring_dedup.plain(docs)
    ranges = None
    for k, (lo, hi) in enumerate(((0, 20), (20, 40), (40, 99))):
        part = texts.where(f"doc_id >= {lo} AND doc_id < {hi}")
        found = index.add(part, texts.where(f"doc_id < {hi}"))
        ranges = found if ranges is None else ranges.unionByName(found)
        if k == 1:
            index.compact()
            assert len(index.runs) == 1
    got = substring_dedup.cut(texts, ranges).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in got} == brute_substrings(rows)


def test_substring_odd_rows(spark):
    out = substring_dedup.rewrite(odd(spark))
    assert out.columns == odd(spark).columns and out.count() >= len(ODD) - 1
    assert substring_dedup.rewrite(odd(spark).limit(0)).count() == 0


# ---- language


def test_language_accuracy_and_odd_rows(spark):
    out = queries.QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "lang"]].merge(out, on="doc_id")
    held = docs[docs.held_out]
    assert len(docs) == len(out) and (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    labelled = frame(spark, [("en", "the cat sat on the mat"), ("fr", "le chat est sur le tapis"), (None, "x"), ("en", None)], "lang string, text string")
    model = language_id.train(labelled)
    assert model.langs == ["en", "fr"]
    got = language_id.predict(odd(spark), model).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"} and len(got) == len(ODD)
    none = language_id.train(labelled.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(odd(spark), none).collect()} == {"und"}


def test_code_lengths_follow_the_definition(spark):
    text = "abracadabra"
    model = language_id.train(frame(spark, [("x", text)], "lang string, text string"))
    grams = Counter()
    data = text.encode()
    for i in range(len(data)):
        padded = bytes(3) + data
        for k in range(4):
            grams[(k, padded[i + 3 - k : i + 3], padded[i + 3])] += 1

    def p(k, context, b):
        if k < 0:
            return 1 / 256
        seen = {s: n for (o, c, s), n in grams.items() if o == k and c == context}
        lower = p(k - 1, context[1:], b)
        if not seen:
            return lower
        total = sum(seen.values()) + len(seen)
        return seen[b] / total if b in seen else len(seen) / total * lower

    for asked in ("abra", "zebra"):
        padded = bytes(3) + asked.encode()
        want = -sum(np.log2(p(3, padded[i : i + 3], padded[i + 3])) for i in range(len(asked)))
        assert abs(model.code_lengths(pa.array([asked]))[0, 0] - want) < 1e-9


# ---- simhash


def test_simhash_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(frame(spark, [(-1, None), (-2, ""), (-3, "q")]))
    rows = docs.collect()
    got = {r["doc_id"]: r for r in simhash_dedup.groups(docs).collect()}
    prints = {r["doc_id"]: simhash_dedup.fingerprint((r["text"] or "").encode(), 3) for r in rows}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == prints
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in ids}


def test_fingerprint_definition():
    from xxhash import xxh64_intdigest

    text = "The cat  sat\ton THE mat É"
    w = ["the", "cat", "sat", "on", "the", "mat", "É"]
    hashes = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > 5)
    assert simhash_dedup.fingerprint(text.encode(), 3) == want
    assert simhash_dedup.fingerprint(b"A b", 3) == xxh64_intdigest(b"a b", 42) and simhash_dedup.fingerprint(b" ", 3) == 0


def test_links_of_a_dense_ball(spark):
    """Many fingerprints near one another link without pairs, and chains follow through."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    near = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (200, 2))} | {base}
    far = {int(x) for x in rng.integers(1 << 62, size=200)}
    prints = sorted(near | far)
    classes = frame(spark, [(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    from twinroute.llm.components import components

    roots = {r["node"] % (1 << 64): r["root"] for r in components(simhash_dedup.links(classes)).collect()}
    assert len({roots[p] for p in near}) == 1
    lone = [p for p in far if all((p ^ q).bit_count() > 2 for q in prints if q != p)]
    assert not set(lone) & set(roots)


def test_keep_first_keeps_columns(spark):
    from pyspark.sql import functions as F

    docs = odd(spark).withColumn("_gone", F.lit(1))
    out = simhash_dedup.keep_first(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert None in ids and 1 in ids and 2 not in ids and ids.count(4) == 2
    assert simhash_dedup.keep_first(docs.limit(0)).count() == 0


def test_keep_first_judges_rows_not_ids(spark):
    """Ids that several texts carry: every group keeps a row, and no row of another group stands in for it."""
    base = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(1, base), (5, base + " x"), (5, other), (7, other + " y"), (9, "alone here in this text of some words"), (9, base), (None, other)]
    docs = frame(spark, rows).withColumn("key", F_lit("k")).withColumn("first", F_lit(0)).withColumn("row", F_lit("r"))
    out = simhash_dedup.keep_first(docs, shingle=5)
    assert out.columns == docs.columns and {r["row"] for r in out.collect()} == {"r"}
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[6]], key=str)


def test_keep_first_takes_similar_texts(spark):
    """Copies with changed words go exactly from a similarity of 0.8 on, however far their fingerprints are."""
    rng = np.random.default_rng(3)
    words_ = [f"w{k}" for k in range(400)]
    line = " ".join(f"same{k}" for k in range(12))
    rows = [(9000, " ".join(f"s{k}" for k in range(8))), (9001, " ".join(f"S{k}" for k in range(9))), (9002, "x y"), (9003, "X  y"), (9004, "x y z")]
    for base in range(30):
        text = [words_[k] for k in rng.integers(0, 400, int(rng.integers(20, 200)))]
        rows.append((100 * base, " ".join(text) + " " + line))
        for copy in range(1, 5):
            edited = list(text)
            for at in rng.integers(0, len(text), int(rng.integers(1, 2 + len(text) // 20))):
                edited[at] = f"new{rng.integers(1 << 30)}"
            rows.append((100 * base + copy, " ".join(edited) + " " + line))
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(group[a], group[b])
            if group[a] != low or group[b] != low:
                group[a] = group[b] = low
                changed = True
    prints = {i: simhash_dedup.fingerprint(t.encode(), 5) for i, t in rows}
    assert sum((prints[a] ^ prints[b]).bit_count() > 2 for a, b in pairs) > 20
    out = simhash_dedup.keep_first(frame(spark, rows), shingle=5)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i in group if group[i] == i)


# ---- quality rules


def brute_measures(text):
    text = text or ""
    w = text.encode().split()
    keys = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if keys[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in quality_rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_equal_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + ODD + [(90, "a b c d e f g h " * 5), (91, "x y\nx y\n\nx y")]
    got = quality_rules.ledger(frame(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((i, *brute_measures(t)) for i, t in rows)


def test_policies_and_ablation(spark):
    docs = odd(spark)
    assert quality_rules.reject(docs).columns == docs.columns
    entries = quality_rules.ledger(docs)
    table = {(r["policy"], r["rule"]): r for r in quality_rules.ablation(entries).collect()}
    bits = [r["fail_bits"] for r in entries.collect()]
    for p, names in quality_rules.POLICIES.items():
        m = quality_rules.mask(names)
        for n in names:
            r = table[(p, n)]
            b = quality_rules.mask((n,))
            assert (r["documents"], r["rejected"], r["only_this_rule"]) == (len(bits), sum(x & m != 0 for x in bits), sum(x & m == b for x in bits))
    assert quality_rules.reject(docs.limit(0)).count() == 0


# ---- URL filters


def test_url_filters_equal_brute_force(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    events = [("a", "x.com", False, day(10), True), ("a", "x.com", False, day(20), False), ("a", "b.x.com", True, day(12), True), ("a", "x.com/p", False, day(0), True), ("a", None, False, day(0), True), ("b", "y.org", False, day(5), False), ("b", "y.org", False, day(5), True)]
    urls = ["http://x.com/", "https://www.b.x.com/q", "http://x.com/p/1?u", "http://y.org", "nonsense", None, "http://u@z.y.org:80/a#b"]
    seen = [(k * 100 + n, u, day(n)) for k, u in enumerate(urls) for n in (0, 9, 10, 15, 19, 20, 90)] + [(999, "http://x.com", None)]
    captures = frame(spark, seen, "page_id long, url string, fetched date")
    got = {r["page_id"]: r for r in url_filters.judge(captures, url_filters.validity(frame(spark, events, "list string, key string, allow boolean, day date, listed boolean"))).collect()}
    active = {"x.com": (10, 20, False), "b.x.com": (12, 9999, True), "x.com/p": (0, 9999, False), "y.org": (5, 9999, False)}
    keys = [["x.com"], ["b.x.com", "x.com", "b.x.com/q"], ["x.com", "x.com/p"], ["y.org"], [], [], ["z.y.org", "y.org", "z.y.org/a"]]
    for pid, _, at in seen[:-1]:
        n = (at - day(0)).days
        on = [k for k in keys[pid // 100] if k in active and active[k][0] <= n < active[k][1]]
        best = max(on, key=len, default=None)
        want = "none" if best is None else "allow" if active[best][2] else "block"
        assert (got[pid]["verdict"], got[pid]["n_active"], got[pid]["entry"]) == (want, len(on), best or ""), (pid, got[pid])
    assert got[999]["verdict"] == "none"
    assert url_filters.judge(captures.limit(0), url_filters.validity(frame(spark, events, "list string, key string, allow boolean, day date, listed boolean"))).count() == 0


# ---- language model


def test_base_scores_equal_brute_force_and_model_is_better(spark, sf):
    out = queries.QUERIES["op8_maxent_lm"](spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in zip(docs.doc_id, docs.text)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(x for i, t in tokens.items() if not held[i] for x in t)
    n, v = sum(c.values()), len(c)
    for r in out.itertuples():
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[x] > 0 for x in t), n)
        assert abs(r.base_score - sum(np.log10((c[x] + 1) / (n + v + 1)) for x in t)) < 1e-6 * abs(r.base_score) + 1e-9
    assert out[out.held_out].score.sum() > out[out.held_out].base_score.sum()


def test_model_chances_sum_to_one(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, [(1, "a b a c"), (2, "b b d"), (3, None)]).withColumn("held_out", F.lit(False))
    model, counts = maxent_lm.train(docs)
    ids = np.arange(maxent_lm.CLASSES)
    f = np.repeat(maxent_lm.histories(np.array([5], np.uint64), np.array([0, 1])), len(ids), axis=1)
    assert abs((10 ** maxent_lm.chances(model, maxent_lm.rows_of(f, ids // maxent_lm.WIDTH), ids)[2]).sum() - 1) < 1e-5
    out = maxent_lm.score(odd(spark).select("doc_id", "text", F.lit(True).alias("held_out")), model, counts).collect()
    assert len(out) == len(ODD) and all(np.isfinite(r["score"]) for r in out)
    assert maxent_lm.score(docs.limit(0), *maxent_lm.train(docs.limit(0))).count() == 0


def test_scores_equal_brute_force_over_the_weights(spark):
    """The score is the sum over tokens of the class's probability by plain softmaxes and the token's share of its class."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.2, 60) % 700)) for i in range(60)] + [(90, None), (91, "new unseen words w1")]
    docs = frame(spark, rows).withColumn("held_out", F.col("doc_id") >= 50)
    model, counts = maxent_lm.train(docs.where("NOT held_out"))
    words_, of = [w for _, t in rows[:50] for w in [*t.split(), None]], {}
    seen = Counter(words_)
    for r in counts.collect():
        of[r["token"] % (1 << 64)] = (r["n"], r["bucket"])
    assert sorted(n for n, _ in of.values()) == sorted(seen.values()) and model.train_tokens == len(words_)
    mass, kinds = Counter(), Counter()
    for h, (n, bucket) in of.items():
        if h not in set(model.top.tolist()):
            mass[bucket] += n
            kinds[bucket] += 1
    m64, mult = (1 << 64) - 1, [int(x) for x in maxent_lm.KINDS]

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    got = {r["doc_id"]: r["score"] for r in maxent_lm.score(docs, model, counts).collect()}
    for i, text in rows:
        t = maxent_lm.tokenize(pa.array([text], pa.string()))
        total = 0.0
        for at, h in enumerate(t.hash.tolist()):
            b = [int(t.hash[at - k]) if at >= k else int(maxent_lm.START) for k in (1, 2, 3)]
            pair = int(words.mix(np.array([(b[0] * mult[1] + b[1]) & m64], np.uint64))[0])
            f = [b[0] * mult[0] & m64, pair, b[1] * mult[2] & m64, b[2] * mult[3] & m64]
            where = np.flatnonzero(model.top == np.uint64(h))
            cls = int(model.top_class[where[0]]) if len(where) else int(t.bucket[at])
            g, inner = divmod(cls, maxent_lm.WIDTH)
            shift = 64 - maxent_lm.ROW_BITS
            a = model.group_bias + sum(model.weights[(x * mult[1] & m64) >> shift] for x in f)
            c = model.class_bias[g] + sum(model.weights[((x ^ ((g + 1) * int(maxent_lm.OF_GROUP) & m64)) * mult[0] & m64) >> shift] for x in f)
            total += np.log10(softmax(a)[g] * softmax(c)[inner])
            if not len(where):
                total += np.log10((of.get(h, (0, 0))[0] + 1) / (mass[cls] + kinds[cls] + 1))
        assert abs(got[i] - total) < 1e-3 * max(1, abs(total)), i


# ---- toxicity


def test_toxicity_held_out(spark):
    out = queries.QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet").merge(out, on="doc_id")
    held = labels[labels.held_out]
    assert held[held.toxic == 0].predicted.mean() < 0.02 and held[held.toxic == 1].predicted.mean() > 0.6
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_toxicity_odd_rows(spark):
    labels = frame(spark, [(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = frame(spark, [(i, "vile brute talk today" if i % 2 else "kind words all day") for i in range(40)])
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, [(1, "a vile brute"), (2, "kind day"), (3, None), (4, "")]), model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4]
    assert len(toxicity.train(docs, labels.limit(0)).keys) == 0
    assert toxicity.score(odd(spark).select("doc_id", "text"), model).count() == len(ODD)


# ---- decontamination


def brute_tiles(item, doc, least):
    marked_i, marked_d, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and a + n not in marked_i and b + n not in marked_d:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return tiles
        tiles.append((a, b, n))
        marked_i |= set(range(a, a + n))
        marked_d |= set(range(b, b + n))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=5, max_size=25), st.lists(st.sampled_from("abcd"), max_size=40))
def test_tiles_equal_brute_force(item, doc):
    known = decontaminate.seeds([7], [" ".join(item)], 3)
    part = pa.record_batch({"text": [" ".join(doc)]})
    found = list(decontaminate.matches(part, known, 1e-9))
    want = brute_tiles(item, doc, 3)
    assert sum(t[3] for t in found) == sum(t[2] for t in want) and sum(t[2] for t in found) == len(want)


@settings(max_examples=25, deadline=None)
@given(st.data())
def test_pairs_with_common_lines_equal_brute_force(data):
    """Items and documents that share a line: the same pairs as by tiling every pair, whatever the step size."""
    line, word = "a b c d e f".split(), st.sampled_from("abcdefgh")
    text = st.tuples(st.lists(word, max_size=8), st.booleans(), st.lists(word, max_size=8)).map(lambda t: t[0] + line * t[1] + t[2])
    items, docs = data.draw(st.lists(text, min_size=1, max_size=14)), data.draw(st.lists(text, max_size=6))
    want = {}
    for d, doc in enumerate(docs):
        for k, item in enumerate(items):
            n = sum(t[2] for t in brute_tiles(item, doc, min(3, len(item)))) if item else 0
            if item and n >= 0.5 * len(item):
                want[d, k] = n
    old = decontaminate.COMMON, decontaminate.STEP
    decontaminate.COMMON, decontaminate.STEP = data.draw(st.sampled_from([(0, 1), (2, 40), old]))
    try:
        known = decontaminate.seeds(list(range(len(items))), [" ".join(x) for x in items], 3, 0.5)
        part = pa.record_batch({"text": pa.array([" ".join(x) for x in docs], pa.string())})
        assert {(d, k): n for d, k, _, n in decontaminate.matches(part, known, 0.5)} == want
        assert sorted(d for d, *_ in decontaminate.matches(part, known, 0.5, one=True)) == sorted({d for d, _ in want})
    finally:
        decontaminate.COMMON, decontaminate.STEP = old


def test_line_that_all_share_makes_no_candidates():
    """A common line that covers too little of every item is no candidate; one that covers enough is found everywhere."""
    texts = lambda t, own: [" ".join(["the line that all share", *(f"{t}{i}x{k}" for k in range(own))]) for i in range(400)]
    for own, pairs in ((15, 0), (3, 400 * 400)):
        known = decontaminate.seeds(list(range(400)), texts("item", own), 5, 0.5)
        assert (len(known.grams[5].items) < 400 * (own + 1)) == (own == 15)
        part = pa.record_batch({"text": texts("doc", own)})
        assert sum(1 for _ in decontaminate.matches(part, known, 0.5)) == pairs
        assert sum(1 for _ in decontaminate.matches(part, known, 0.5, one=True)) == (400 if pairs else 0)


def test_reordered_passages_are_caught(spark):
    item = " ".join(f"tok{k}" for k in range(24))
    w = item.split()
    docs = frame(spark, [(1, "x y " + " ".join(w[12:] + ["mid"] + w[:12])), (2, " ".join(w[:6])), (3, item.upper() + "!"), (4, None), (5, "")])
    bench = frame(spark, [(9, item), (10, None), (11, "short one"), (None, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 9): 1.0, (3, 9): 1.0}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5] and kept.columns == docs.columns
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.drop_contaminated(odd(spark), bench).count() == len(ODD)


# ---- pipeline


def similar_groups(texts):
    """Smallest id reachable over five-word similarities of 0.8 or more."""
    split = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in split.items()}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and group[a] != group[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return group


def test_pipeline_equals_brute_force(spark, sf):
    import corpus_pipeline

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    entries = quality_rules.apply_policy(quality_rules.ledger(spark.read.parquet(f"{sf}/documents.parquet")), quality_rules.POLICIES["v2"])
    docs = {i: docs[i] for i in sorted(r["doc_id"] for r in entries.where("kept").collect())}
    group = similar_groups(docs)
    docs = {i: t for i, t in docs.items() if group[i] == i}
    rewritten = brute_substrings(docs.items())
    docs = {i: t for i, (n, gone, t) in rewritten.items() if gone < n or not gone}
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    split = lambda t: [bytes(w.data[a:b]) for w in [decontaminate.tokens(pa.array([t]))] for a, b in zip(w.start, w.end)]
    for item in map(split, bench):
        grams = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}
        for i, t in list(docs.items()):
            d = split(t)
            if grams & {tuple(d[k : k + 5]) for k in range(len(d) - 4)} and sum(x[2] for x in brute_tiles(item, d, 5)) >= 0.5 * len(item):
                del docs[i]
    got = corpus_pipeline.run(spark, sf).collect()
    e = packing.Encoder()
    want = Counter(i for i, t in docs.items() for _ in range(-(-(len(e.ids(t)) + 1) // 1024)))
    assert Counter(r["doc_id"] for r in got) == want
    lengths = {(r["doc_id"], r["piece"]): r["length"] for r in got}
    for i, t in docs.items():
        assert [lengths[(i, k)] for k in range(want[i])] == cut_lengths(len(e.ids(t)) + 1, 1024)


def test_pipeline_takes_similar_texts(spark, sf):
    """The near-duplicate stage equals brute force over five-word similarities of 0.8 or more."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    group = similar_groups({r["doc_id"]: r["text"] for r in docs.collect()})
    got = corpus_pipeline.near_duplicates(spark, docs, sf).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i in group if group[i] == i)
