"""Each operator against brute force on small rows that hold the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import ann, decontaminate, mixing, pii, queries, secrets, simhash, substring, tokens, toxicity, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_2 string"


def documents(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "x") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, names="abcdefgh"):
    return " ".join(rng.choice(names) for _ in range(n))


def hamming_components(bits, radius):
    ids = sorted(bits)
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (bits[i] ^ bits[j]).bit_count() <= radius and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return group


def test_masks_cover_every_pair():
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(4)]
    rng = random.Random(0)
    for _ in range(5000):
        apart = sum(1 << i for i in rng.sample(range(64), 4))
        assert any(not m & apart for m in masks)


def slow_fingerprint(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [2, 16_384])
def test_near_duplicates_are_those_of_all_pairs(spark, bucket):
    rng = random.Random(1)
    base = words(rng, 60).split()
    texts = [None, "", " \t", "one", "One two"]
    for _ in range(25):
        part = list(base)
        part[rng.randrange(60)] = "Z"
        texts.append(" ".join(part))
    texts += [words(rng, 40) for _ in range(10)] + ["Ä ß " * 5000]
    rows = list(enumerate(texts)) + [(5, texts[5])]
    found = simhash.near_duplicates(documents(spark, rows), bucket=bucket).collect()
    assert len(found) == len(rows)
    bits = {i: slow_fingerprint(t) for i, t in rows}
    group = hamming_components(bits, 4)
    assert {(r.doc_id, r.bits & (2**64 - 1), r.component_id) for r in found} == {(i, bits[i], group[i]) for i in bits}


@pytest.mark.parametrize("radius", [1, 3])
def test_large_buckets_link_what_an_odd_radius_links(spark, radius):
    rng = random.Random(radius)
    # b and c are within the radius, both one bit more from the smallest.
    bits = {0, (1 << (radius + 1)) - 1, (1 << (radius + 1)) - 1 ^ 1 ^ 1 << 20}
    bits |= {sum(1 << i for i in rng.sample(range(12), rng.randrange(12))) << 24 for _ in range(40)}
    found = simhash.links(spark.createDataFrame([(b,) for b in bits], "bits long"), radius, 2).collect()
    assert all((r.a ^ r.b).bit_count() <= radius for r in found)
    want, group = hamming_components({b: b for b in bits}, radius), {b: b for b in bits}
    for _ in bits:
        for r in found:
            group[r.a] = group[r.b] = min(group[r.a], group[r.b])
    assert group == want


def test_repeats_are_those_of_a_count(spark):
    rng = random.Random(2)
    passage = words(rng, 30, [f"w{i}" for i in range(50)])
    texts = [None, "", "a b", passage, f"x {passage} y", f"{passage} {words(rng, 20)}", "a " * 60]
    texts += [words(rng, rng.randrange(5, 80)) for _ in range(20)] + [texts[4]]
    window = 8
    listed = [(t or "").split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in listed for i in range(len(w) - window + 1))
    found = substring.remove_repeats(
        documents(spark, enumerate(texts)), window=window, phrase=3, shard_segments=20, part_rows=5
    )
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()}
    for i, w in enumerate(listed):
        gone = {p for a in range(len(w) - window + 1) if count[tuple(w[a : a + window])] > 1 for p in range(a, a + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_tokens_are_those_of_whole_texts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(queries.TOKENIZER)
    encoder = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    texts = [None, "", "  ", "a  b", "<s> </s>", "▁ ▁ x", "x\n y\t z " * 50, "é" * 300, words(rng, 900, ["ab", " c", "\nd", "ü"])]
    found = tokens.token_counts(documents(spark, enumerate(texts)), path, limit=100, piece_chars=20, call_bytes=64)
    got = {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in found.collect()}
    for i, t in enumerate(texts):
        n = len(encoder.encode(t or ""))
        assert got[i] == (n, len((t or "").encode()), n > 100)


def test_tokens_of_long_texts_that_end_in_a_space(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(queries.TOKENIZER)
    encoder = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["word " * 3277, "x" * 16_390 + " ", "x" * 16_390 + "  ", "x" * 16_390 + " \n", "x" * 16_390 + " y "]
    found = tokens.token_counts(documents(spark, enumerate(texts)), path)
    assert {r.doc_id: r.n_tokens for r in found.collect()} == {i: len(encoder.encode(t)) for i, t in enumerate(texts)}


def test_benchmark_parts_find_what_one_automaton_finds(spark):
    rng = random.Random(4)
    items = spark.createDataFrame([(i, words(rng, n)) for i, n in enumerate([0, 1, 3, 12, 15])] + [(None, None)], "item_id long, text string")
    docs = documents(spark, [(0, None), (1, ""), (2, "!?"), *[(i, words(rng, 200).upper()) for i in range(3, 12)]])
    whole = decontaminate.digest(decontaminate.contamination(docs, items, window=4))
    parts = decontaminate.digest(decontaminate.contamination(docs, items, window=4, part_bytes=20))
    columns = ["doc_id", "n_words", "n_hit", "items_sha256", "contaminated", "hit_spans"]
    assert sorted(map(str, whole.select(columns).collect())) == sorted(map(str, parts.select(columns).collect()))


def test_checked_secrets_need_their_checksum(spark):
    body = "xyz" * 10
    value, end = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        end = secrets.BASE62[digit] + end
    texts = [None, "", f"ghp_{body}{end}", f"ghp_{body}{'0' * 6}", "İ TOKEN: 'abcdef' tokenſecret=abc"]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(documents(spark, enumerate(texts))).collect()}
    assert got == {0: "", 1: "", 2: "checked:0:40", 3: "", 4: "assign:2:16"}


def test_key_blocks_may_have_header_lines(spark):
    body = "\n".join(["MIIEabcd+/01" * 5] * 3)
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0123ABCD\n\n"
    block = "-----BEGIN RSA PRIVATE KEY-----\n{}" + body + "\n-----END RSA PRIVATE KEY-----"
    texts = [block.format(""), block.format(headers), block.format(headers.replace("\n", "\r\n")), block.format("not a key.\n")]
    got = [r.spans for r in secrets.find_secrets(documents(spark, enumerate(texts))).orderBy("doc_id").collect()]
    for text, spans in zip(texts, got):
        assert (f"key_block:0:{len(text)}" in spans) == ("not a key" not in text)


def test_strict_personal_data_and_redaction(spark):
    texts = [None, "", "a@b.c@d.e 1.2.3.4 256.1.1.1 4111 1111 1111 1112", "call +1 (555) 555-0100 or x@y.zz"]
    rows = {r.doc_id: r for r in pii.find_pii(documents(spark, enumerate(texts)), redact=True).collect()}
    assert rows[0].redacted_text is None and rows[1].spans == ""
    assert (rows[2].n_email, rows[2].n_ip, rows[2].n_card) == (1, 1, 0)
    assert rows[3].redacted_text == "call [PHONE] or [EMAIL]"


def test_longer_protocol_and_spelled_addresses_go(spark):
    rng = random.Random(12)
    names = [f"word{chr(97 + i)}" for i in range(20)]
    texts = [f"{words(rng, 12, names)} mail jo{chr(97 + i % 26)}@site{i}.example.org or 10.0.{i % 200}.7 {words(rng, 12, names)}" for i in range(400)]
    texts = [f"{t} version 2.{i % 30}.4 of 2021-0{i % 9 + 1}-1{i % 9}" for i, t in enumerate(texts)]
    hidden = ["2001:db8:85a3:0:0:8a2e:370:7334", "anna.berg (at) mailhost (dot) org", "tom @ homepage.net", "ida[at]inbox.example[dot]com"]
    harmless = ["12:30:45:10", "00:1b:44:11:3a:b7", "3.50 per unit", "version 2.10.4", "us @ 10.30"]
    texts += [f"{words(rng, 9, names)} {h} {words(rng, 9, names)}" for h in hidden + harmless]
    got = [r.redacted_text for r in pii.find_pii(documents(spark, enumerate(texts)), redact=True).orderBy("doc_id").collect()][400:]
    for h, text in zip(hidden + harmless, got):
        assert (h in text) == (h in harmless), (h, text)
    assert "[IP_LIKE]" in got[0] and all("[EMAIL_LIKE]" in t for t in got[1:4])


def test_boosted_trees_learn_and_thresholds_hold():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 5, (2000, 4)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 1] < 2)).astype(float)
    p = pii.boost(x, y).probability(x)
    assert ((p > 0.5) == (y > 0)).mean() > 0.97
    limit = pii.thresholds(p, y, np.zeros(2000), 0.9)[0]
    assert y[p >= limit].mean() >= 0.9


def test_nearest_have_high_recall_and_exact_scores(spark):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((400, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(400, None), (440, [0.0] * 24), (460, [float("nan")] * 24), (480, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.nearest(df, k=10, query_rows=7, vector_rows=90).collect()
    wide = vectors.astype(float)
    hits = 0
    for q in range(0, 400, 20):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        scores = {i: float(s) for i, s in enumerate(wide @ wide[q]) if i != q}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:10]
        hits += len(set(best) & {r.vec_id for r in mine})
        assert all(abs(r.score - scores[r.vec_id]) < 1e-9 for r in mine)
    assert len(found) == 200 and hits >= 190
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_take_repeated_rows_and_ids_as_rows(spark):
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((50, 6)).astype(np.float32).tolist()
    rows = list(enumerate(vectors)) + [(0, vectors[0]), (0, vectors[1]), (None, vectors[0]), (20, vectors[20])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    found = ann.nearest(df, k=5, query_rows=2, vector_rows=9).collect()
    wide = np.array([v for _, v in rows], float)
    want = []
    for q, (q_id, _) in enumerate(rows):
        if q_id is None or q_id % 20:
            continue
        scored = sorted((-float(wide[c] @ wide[q]), i is None, i or 0) for c, (i, _) in enumerate(rows) if c != q)
        want += [(q_id, n + 1, None if missing else i) for n, (_, missing, i) in enumerate(scored[:5])]
    assert sorted(map(str, ((r.query_id, r.rank, r.vec_id) for r in found))) == sorted(map(str, want))


def test_distrust_flows_back_and_rules_win(spark):
    link = '<a href="http://bad.net/es/x">'
    rows = [(0, None, None), (1, "no host", link), (2, "http://bad.net/es/1", ""), (3, "http://bad.net/other", ""),
            (4, "http://friend.org/a", link), (5, "http://A.COM/en/", ""), (6, "http://x.example.com/en/1?q", ""),
            (7, "http://www.example.com/en/", ""), (8, "http://bad.net/es/2", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages).collect()}
    assert got[0] == got[1] == (None, "allow")
    assert got[3] == (None, "block") and got[4] == (None, "block") and got[5] == ("com/", "allow")
    assert got[6] == ("example.com/en/", "block") and got[7] == ("www.example.com/en/", "allow")
    ranks = {r.host: r.distrust for r in urls.judge_urls(pages).collect()}
    assert ranks["bad.net"] > ranks["friend.org"] > 0


def test_mix_meets_targets_and_agrees_with_itself(spark):
    rng = random.Random(7)
    sizes = [(i, f"s{rng.randrange(4)}" if i % 9 else None, rng.randrange(0, 300)) for i in range(2000)]
    docs = spark.createDataFrame(sizes, "doc_id long, source string, size long")
    first, again = (sorted(map(tuple, mixing.mix(docs.repartition(n), bin_rows=50).collect())) for n in (3, 7))
    assert len(first) == 2000
    assert sorted(map(str, first)) == sorted(map(str, again))
    taken, target = Counter(), {}
    for _, source, size, _, goal, copies, words_taken in first:
        assert words_taken == copies * size <= 3 * size
        taken[source] += words_taken
        target[source] = goal
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_toxicity_learns_held_out_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = words(rng, 40, ["tion", "the", "ever", "then", "ring"]).split()
        if toxic:
            text[rng.randrange(40)] = rng.choice(["scumzz", "scumly"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = documents(spark, rows + [(901, None), (902, "")])
    known = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, known).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.97
    assert got[901].score == got[902].score and got[901].predicted == 0
    none = toxicity.toxicity_scores(docs, known.limit(0)).agg(F.max("score")).first()[0]
    assert none == 0.0


def slow_log_ratios(rows):
    """Log ratios of all expressions, from (text, class or None): plain loops over every one of them."""
    grams = [(g, y) for text, y in rows for w in text.lower().split() for g in toxicity.expressions(w)]
    order, off = toxicity.ORDER, toxicity.DISCOUNT
    levels = {order: Counter(g for g, _ in grams)}
    for k in range(order - 1, 0, -1):
        longer = {g for g in levels[k + 1] if len(g) == k + 1} | {g for g in levels[order] if g[0] == "\x02" and len(g) == k + 1}
        levels[k] = Counter(g[1:] for g in longer)
    shared = {g: n / sum(levels[1].values()) for g, n in levels[1].items()}
    for k in range(2, order + 1):
        mass, kinds = Counter(), Counter()
        for g, n in levels[k].items():
            mass[g[:-1]] += n
            kinds[g[:-1]] += 1
        found = {g: (max(n - off, 0) + off * kinds[g[:-1]] * shared[g[1:]]) / mass[g[:-1]] for g, n in levels[k].items()}
        shared = found if k == order else shared | found
    logs = []
    for y in (1, 0):
        counts, mass, kinds = Counter(g for g, c in grams if c == y), Counter(), Counter()
        for g, n in counts.items():
            mass[g[:-1]] += n
            kinds[g[:-1]] += 1
        logs.append({
            g: np.log((max(counts[g] - off, 0) + off * kinds[g[:-1]] * p) / mass[g[:-1]] if mass[g[:-1]] else p)
            for g, p in shared.items()
        })
    return {g: logs[0][g] - logs[1][g] for g in shared}


def test_every_expression_keeps_its_log_ratio(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("abcde ") for _ in range(60)) + f" once{i}", [None, 1, 0][i % 3]) for i in range(60)]
    tagged = spark.createDataFrame([(t, {None: 0, 1: 1, 0: 2}[y]) for t, y in rows], "text string, tag int")
    counts = toxicity.count_expressions(tagged)
    ratios = toxicity.log_ratios(counts, toxicity.shared_model(counts))
    want, got = slow_log_ratios(rows), {r.g: r["all"] for r in ratios.collect()}
    assert set(got) == set(want) and all(abs(got[g] - want[g]) < 1e-9 for g in want)
    table = sorted(((r["key"] % 2**64, r["all"]) for r in toxicity.value_table(ratios).collect()))
    keys, values = np.array([k for k, _ in table], np.uint64), np.array([[v] for _, v in table])
    words = sorted({w for t, _ in rows for w in t.split()})
    for word, found in zip(words, toxicity.word_sums(words, keys, values)):
        assert abs(found[0] * toxicity.UNIT - sum(want[g] for g in toxicity.expressions(word))) < 1e-6


def test_rare_expressions_count_whatever_the_words_sent(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        text = words(rng, 40, ["tion", "the", "ever", "then", "ring"]).split()
        if i % 5 == 0:
            text[rng.randrange(40)] = rng.choice(["scumzz", "scumly"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 5 == 0)))
    learns = [i for i in range(1000, 1020) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    plain = "the ring then ever tion " * 7 + "the ring then ever "
    # One learning row has the word, one time.
    rows += [(learns[0], plain + "qjqjq"), (2000, plain + "qjqjq"), (2001, plain + "ring"), (2002, plain + "qjqjq"), (2003, None)]
    labels.append((learns[0], 1))
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, known).collect()}
    assert got[2000] == got[2002] > got[2001] + 0.05
    few = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, known, part_expressions=300).collect()}
    assert few.keys() == got.keys() and all(abs(few[i] - got[i]) < 1e-9 for i in got)


@pytest.mark.parametrize("share", [3, 1])
def test_rows_alike_are_taken_as_far_as_the_words_go(spark, share):
    rows = [(None if i % share == 0 else i, f"s{i % 3}", 100) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    sums = mixing.mix(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.count("*").alias("n"))
    for r in sums.collect():
        assert r["n"] == 1000 and abs(r["taken"] - r["target"]) <= 100
    again = [sorted(r["copies"] for r in mixing.mix(docs).collect()) for _ in range(2)]
    assert again[0] == again[1]


def test_pipeline_takes_out_what_it_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.keep_one_of_each(spark, docs.union(docs.limit(3)), SF)
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)
    clean = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert clean.columns == docs.columns
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_unrelated_texts_with_one_id_or_none_all_stay(spark):
    rng = random.Random(6)
    lone = [words(rng, 60, [f"w{i}" for i in range(300)]) for _ in range(8)]
    rows = [(-1, t) for t in lone[:3] * 2] + [(5, t) for t in lone[3:6]] + [(7, lone[6]), (-1, lone[6])]
    docs = documents(spark, rows + [(6, lone[3]), (4, lone[7]), (4, lone[7])]).withColumn("doc_id", F.expr("nullif(doc_id, -1)"))
    kept = corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()
    want = [(None, t) for t in lone[:3]] + [(5, t) for t in lone[3:6]] + [(7, lone[6]), (4, lone[7])]
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(want)


# Columns that bear the names of what the operators add or use inside.
CLASHES = [
    "score", "predicted", "held_out", "spans", "n_words", "n_hit", "hit_words", "kept_text", "size", "target", "taken",
    "copies", "bits", "component_id", "n_tokens", "over_limit", "k1", "anchor", "tag", "g", "key", "id", "rank", "rule",
]


def awkward(spark):
    """NULL in every column, empty and long texts, repeated rows, clashing names."""
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \t\n", "one", passage, passage, f"{passage} mail a@b.cc token=abcdef12", "é ü " * 20_000, "7 " * 50_000, passage]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], (None, None, None, None, None), (None, passage, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("mine") for c in CLASHES}), len(rows)


def labels_of(spark):
    return spark.createDataFrame([(i, i % 2, "x") for i in range(10)] + [(None, None, None), (1, None, "x")], "doc_id long, toxic int, score string")


ITEMS = [(1, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13", "x"), (1, "one", "x"), (None, None, None), (2, "", "x")]
WHOLE_TABLE = {
    "op2": lambda s, d: simhash.near_duplicates(d),
    "op4": lambda s, d: tokens.token_counts(d, __import__("public_tokenizers").path(queries.TOKENIZER)),
    "op6": lambda s, d: toxicity.toxicity_scores(d, labels_of(s)),
    "op7": lambda s, d: substring.remove_repeats(d),
    "op8": lambda s, d: decontaminate.digest(
        decontaminate.contamination(d, s.createDataFrame(ITEMS, "item_id long, text string, hit_words string"))
    ),
    "op9": lambda s, d: secrets.find_secrets(d),
    "op10": lambda s, d: pii.find_pii(d, redact=True),
    "op1": lambda s, d: mixing.mix(d.withColumn("size", mixing.word_count("text"))),
}


@pytest.mark.parametrize("name", WHOLE_TABLE)
def test_awkward_tables_keep_every_row(spark, name):
    docs, n = awkward(spark)
    found = WHOLE_TABLE[name](spark, docs)
    assert len(found.columns) == len(set(found.columns))
    rows = found.collect()
    assert len(rows) == n
    # Repeated rows have one result.
    twins = [r for r in rows if r.doc_id == 4]
    assert len(twins) == 2 and twins[0] == twins[1]
    if "lang" in found.columns:
        assert {r.lang for r in rows} == {"en", None} and {r.anchor for r in rows} == {"mine"}
    assert WHOLE_TABLE[name](spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_awkward_tables(spark, stage):
    docs, n = awkward(spark)
    kept = stage(spark, docs, SF)
    rows = kept.collect()
    assert 0 < len(rows) <= n
    assert len(kept.columns) == len(set(kept.columns))
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert kept.columns == docs.columns
        assert {r.anchor for r in rows} == {"mine"}


def test_selection_of_spans_in_a_text_full_of_them():
    text = " ".join(f"user{i}@host{i}.example.com +1 555 01{i % 90 + 10} 4{i % 10}77" for i in range(5000))
    strict = pii.strict_spans(text)
    taken = pii.Ranges(strict)
    step = max(1, len(strict) // 300)
    for span in pii.proposals(text)[::step]:
        assert taken.meets(span) == any(span[1] < b and a < span[2] for _, a, b in strict)
    assert all(a < b for a, b in zip(taken.ends, taken.starts[1:]))


def test_anchors_of_many_texts_are_those_of_each():
    rng = random.Random(9)
    texts = [words(rng, n, ["ab", "c", "é", "\t x\n"]).encode() for n in [0, 3, 60, 35, 34, 0, 200, 36, 1]]
    whole = substring.Segments(texts, 35, 8)
    for i, text in enumerate(texts):
        mine, alone = np.flatnonzero(whole.owner == i), substring.Segments([text], 35, 8)
        listed = text.split()
        windows = [p for s in mine for p in range(whole.first[s], whole.last[s] + 1)]
        assert windows == list(range(max(0, len(listed) - 34)))
        assert whole.anchors[mine].tolist() == alone.anchors.tolist()
        assert [whole.words(s) for s in mine] == [b" ".join(listed[whole.first[s] : whole.last[s] + 35]) for s in mine]
