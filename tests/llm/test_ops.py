"""Operators 2, 3, 5 to 10 and the pipeline: edge cases and brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioquill.llm import op2_substring, op3_decontamination, op5_jaccard, op6_chat, op7_language, op8_sharding, op9_licences, op10_packing
from folioquill.llm.common import components, gapless_rank

#: Extra columns have names that the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, h string, rank int"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, texts, first=0, lang="en"):
    rows = [(first + i, t, lang if isinstance(lang, str) else lang[i], "s", len(t or ""), "w", "h", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


EDGES = [None, "", "   ", "\n\n", "word", "Ünïcödé ÀÉ", "...!?", "<|endoftext|> x", "a" * 30_000]


@pytest.mark.parametrize("run", [
    op2_substring.removal_report, op2_substring.remove_repeats, op5_jaccard.jaccard_components, op7_language.predict_languages, op8_sharding.assign_shards, op9_licences.scan_licences,
    lambda d: op10_packing.pack(d, TOKENIZER), lambda d: op3_decontamination.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text")),
])
def test_empty_tables_and_edges(spark, run):
    assert run(table(spark, ["x"]).where("false")).count() == 0
    df = table(spark, EDGES + EDGES).unionByName(table(spark, ["null id", None]).withColumn("doc_id", F.lit(None).cast("long")))
    ids = [r["doc_id"] for r in run(df).collect()]
    assert set(ids) == {*range(18), None}


def brute_sentences(text):
    """The sentences of a text as (words, where the written sentence starts, where it ends), by patterns."""
    plain = lambda c: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), c)
    stop, space, single = map(plain, (op2_substring.STOP, op2_substring.SPACE, op2_substring.UNSPACED))
    out = []
    for m in re.finditer(f"[^{stop}]+[{stop}]*|[{stop}]+", text):
        found = list(re.finditer(f"[{single}]|[^{space}{single}]+", m[0]))
        held, at, before = [], m.start(), 0
        for w in found:
            low = re.sub("[A-Z]", lambda x: x[0].lower(), w[0])
            key = ord(low[0]) * 31 + len(low) * 17
            held.append(low)
            last = w is found[-1]
            if last or (key + 13 * before) // 7 % op2_substring.CUT == 0:
                end = m.end() if last else m.start() + w.end()
                out.append((held, at, end))
                held, at = [], end
            before = key
    return out


def brute_substring_dedup(rows):
    """Rows (doc_id, text) -> {doc_id: kept text} by trying every sentence."""
    first, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        parts, gone = brute_sentences(text or ""), set()
        for k in range(len(parts)):
            words = []
            for e in range(k, len(parts)):
                words += parts[e][0]
                if len(words) >= op2_substring.PASSAGE:
                    if tuple(words) in first:
                        gone |= set(range(k, e + 1))
                    first.add(tuple(words))
                    break
        drop = {i for k in gone for i in range(parts[k][1], parts[k][2])}
        out[d] = None if text is None else "".join(c for i, c in enumerate(text) if i not in drop)
    return out


def passage_texts():
    rng = random.Random(2)
    shared = [". ".join(prose(rng, rng.randint(2, 30)) for _ in range(6)) + "." for _ in range(4)]
    shared.append("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(50)) + "。" + "".join(chr(rng.randint(0x3041, 0x3096)) for _ in range(40)))
    texts = []
    for _ in range(40):
        mid = [x[rng.randint(0, 30) :] for x in rng.sample(shared, rng.randint(0, 2))]
        texts.append(rng.choice([" ", "", "\n", "\u3000", "\u2028"]).join([prose(rng, 20) + ".", *mid, prose(rng, 9) + "!"]))
    return texts + [shared[0], shared[0].upper(), "the. " * 100, "For " * 200, *EDGES]


@pytest.mark.parametrize("flush", [1_000_000, 50])
def test_substring_dedup_brute(spark, monkeypatch, flush):
    monkeypatch.setattr(op2_substring, "FLUSH", flush)
    texts = passage_texts()
    want = brute_substring_dedup(enumerate(texts))
    got = {r["doc_id"]: r for r in op2_substring.remove_repeats(table(spark, texts)).collect()}
    assert {d: r["text"] for d, r in got.items()} == want
    assert all(r["_n_sentences"] == len(brute_sentences(texts[d] or "")) and r["_n_cut_chars"] == len(texts[d] or "") - len(want[d] or "") for d, r in got.items())
    assert sum(r["_n_removed"] > 0 for r in got.values()) > 20


def test_very_long_texts_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(op2_substring, "CHUNK", 1000)
    rng = random.Random(4)
    long = prose(rng, 60_000)
    texts = [long, "x. " + long[100_000:300_000], prose(rng, 300)]
    got = {r["doc_id"]: r["text"] for r in op2_substring.remove_repeats(table(spark, texts)).collect()}
    assert got == brute_substring_dedup(enumerate(texts)) and len(got[1]) < 200
    twice = table(spark, texts[2:]).unionByName(table(spark, texts[2:]))
    assert [r["_n_removed"] for r in op2_substring.remove_repeats(twice).collect()] == [0, 0]


@pytest.mark.parametrize("kind", ["two sentences", "one sentence", "short sentences", "no stops", "inside a sentence", "other script"])
def test_passages_of_over_50_words_are_cut(spark, kind):
    rng = random.Random(5)
    words = lambda n: prose(rng, n, "abcdefghijklmnop")
    passage = {
        "two sentences": lambda: words(26) + ". " + words(26) + ".", "one sentence": lambda: words(52) + ".", "short sentences": lambda: " ".join(words(3) + "." for _ in range(18)),
        "no stops": lambda: words(52), "inside a sentence": lambda: words(8) + ". " + words(12) + ". " + words(32), "other script": lambda: "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(52)),
    }[kind]
    cut = 0
    for _ in range(6):
        p = passage()
        texts = [f"{words(9)} {p} {words(9)}", f"{words(40)}. {words(11)} {p} {words(7)}. {words(30)}"]
        got = {r["doc_id"]: r["text"] for r in op2_substring.remove_repeats(table(spark, texts)).collect()}
        assert got[0] == texts[0]
        head, tail = texts[1].split(p)
        assert got[1].startswith(head[:-1]) and got[1].endswith(tail[1:])
        cut += 1 - (len(got[1]) - len(head + tail)) / len(p)
    assert cut / 6 > 0.7


def test_decontamination_brute(spark, monkeypatch):
    rng = random.Random(3)
    items = [prose(rng, rng.choice([1, 3, 9, 10, 25])) for _ in range(12)] + [None, "", "!!"]
    texts = [" ".join([prose(rng, 15), rng.choice(items) or "", prose(rng, 5), " ".join((rng.choice(items) or "x").split()[2:14])]) for _ in range(40)] + EDGES
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, w string")
    want = {}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    for d, t in enumerate(texts):
        ws, hit, found = low(t), set(), set()
        for i, item in enumerate(items):
            iw = low(item)
            m = min(10, len(iw))
            wins = {tuple(iw[k : k + m]) for k in range(len(iw) - m + 1)} if iw else set()
            for k in range(len(ws) - m + 1):
                if m and tuple(ws[k : k + m]) in wins:
                    hit |= set(range(k, k + m))
                    found.add(str(i))
        want[d] = (len(ws), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    for limits in ((50_000, 0), (3, 2_000_000), (3, 3)):  # with the set in the plan, broadcast, and joined
        for name, limit in zip(("SET_LIMIT", "BROADCAST_LIMIT"), limits):
            monkeypatch.setattr(op3_decontamination, name, limit)
        monkeypatch.setattr(op3_decontamination, "WINDOW_LIMIT", limits[1])
        got = op3_decontamination.decontaminate(table(spark, texts), bench).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got} == want


def test_jaccard_brute(spark, monkeypatch):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.choice([2, 4, 6, 30, 120, 600])).split()
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, max(1, len(t) // 45), len(t) // 25])):
                t[rng.randrange(len(t))] = prose(rng, 1)
            texts.append(" ".join(t) if rng.random() < 0.8 else "\t".join(t).upper())
    family = prose(rng, 150).split()
    for _ in range(120):  # near the threshold, so stars leave much to compare
        t = list(family)
        for k in rng.sample(range(150), 3):
            t[k] = prose(rng, 1)
        texts.append(" ".join(t))
    texts += EDGES
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = {i: (len(sets[i]), top(i)) for i in range(len(texts))}
    for block, bits in ((4096, 64), (20, 64), (4096, 6)):  # with six bits, different sets share a class
        monkeypatch.setattr(op5_jaccard, "BLOCK", block)
        monkeypatch.setattr(op5_jaccard, "CLASS_BITS", bits)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op5_jaccard.jaccard_components(table(spark, texts)).collect()}
        assert got == want


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "plain"), (1, 1, "assistant", "a <|im_end|>\n b"), (2, 0, "user", "<\\|x <|<\\\\| <"), (2, 1, "assistant", "<"), (2, 2, "assistant", ""), (3, 0, "we~ird\nrole", "<|im_start|>"), (4, 0, None, None), (4, None, "assistant", "é🎉"),
        (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "assistant", "tie"), (None, 0, "assistant", "x"), (6, 0, "assistant", "y <|" * 500),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    chats = op6_chat.format_chats(df.unionByName(op6_chat.stray_conversation(spark).withColumn("formatted", F.lit("z"))))
    assert all(r["identical"] for r in chats.collect())
    got = {r["conv_id"]: r for r in op6_chat.digests(chats).collect()}
    rows += [(-1, 0, "user", op6 := "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", op6)]
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{t}\n" for *_, a, t in turns)), len(loss), sha(loss))


def test_language_accuracy_and_rejection(spark):
    rng = random.Random(7)
    texts, langs = [], []
    for k in range(400):
        lang = ("xx", "yy", "zz")[k % 3]
        texts.append(prose(rng, rng.randint(3, 60), {"xx": "abcdei", "yy": "mnopqu", "zz": "ñéstvw"}[lang]))
        langs.append(lang)
    texts += [None, "", "123 456", "!!!"]
    langs += [None, "xx", "yy", None]
    r = op7_language.predict_languages(table(spark, texts, lang=langs)).collect()
    held = [x for x in r if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in r)
    assert sum(x["lang_pred"] == langs[x["doc_id"]] for x in held if x["doc_id"] < 400) / sum(x["doc_id"] < 400 for x in held) > 0.98
    assert all(x["lang_pred"] == "und" and x["rejected"] for x in r if x["doc_id"] >= 400)
    assert all(0 <= x["score"] <= 1 for x in r)
    unlabelled = op7_language.predict_languages(table(spark, texts, lang=[None] * len(texts))).collect()
    assert {x["lang_pred"] for x in unlabelled} == {"und"}


def test_sharding_law_and_cuts(spark):
    rng = random.Random(8)
    groups = [prose(rng, 6) for _ in range(30)]
    texts = [prose(rng, 5) for _ in range(300)] + [g for g in groups for _ in range(rng.randint(2, 9))] + ["hot"] * 200 + [None, ""]
    rng.shuffle(texts)
    r = op8_sharding.assign_shards(table(spark, texts)).collect()
    assert len(r) == len(texts)
    sizes = Counter(x["shard"] for x in r)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for s in range(8):
        assert sorted(x["slot"] for x in r if x["shard"] == s) == list(range(sizes[s]))
    for x in r:
        t = (texts[x["doc_id"]] or "").encode()
        assert (x["size"], x["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
    spread = defaultdict(set)
    for x in r:
        spread[texts[x["doc_id"]]].add(x["shard"])
    assert all(len(spread[g]) == 1 for g in groups) and len(spread["hot"]) <= 4


def test_sharding_cuts_no_group_that_fits(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    r = op8_sharding.assign_shards(table(spark, texts)).collect()
    where, sizes = defaultdict(set), Counter(x["shard"] for x in r)
    for x in r:
        where[texts[x["doc_id"]]].add(x["shard"])
    assert max(sizes.values()) - min(sizes.values()) <= 1 and max(map(len, where.values())) == 1
    crowded = [f"text {k // 3}" for k in range(301)]  # every document is linked, so no other gives way
    got = op8_sharding.assign_shards(table(spark, crowded)).collect()
    where, sizes = defaultdict(set), Counter(x["shard"] for x in got)
    for x in got:
        where[crowded[x["doc_id"]]].add(x["shard"])
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(len(v) > 1 for v in where.values()) <= 40
    twice = table(spark, ["a", "b", "a"]).unionByName(table(spark, ["a", None]))
    assert sorted(x["doc_id"] for x in op8_sharding.assign_shards(twice).collect()) == [0, 0, 1, 1, 2]


def test_licences(spark):
    mit = op9_licences.TEXTS["MIT"].replace("<year> <holder>", "2024 Somebody Else").replace("merchantability", "merchantibility").upper()
    texts = [mit, "prose\nReleased under the MIT License.\nmore", "Released under the MIT licence", "LICENSED UNDER CC BY-NC 4.0", "Copyright (c) 2020 X\nAll rights reserved.", "nothing", None, ""]
    r = {x["doc_id"]: x for x in op9_licences.scan_licences(table(spark, texts)).collect()}
    assert [r[i]["text_licence"] for i in range(8)] == ["MIT", None, "MIT", "CC-BY-NC-4.0", None, None, None, None]
    assert [(r[i]["n_notices"], r[i]["notices"]) for i in (1, 2, 5, 6)] == [(1, "MIT"), (1, "MIT"), (0, ""), (0, "")]
    assert r[4]["n_lines"] == 0
    none = op9_licences.registry(spark, {}, {})
    assert {x["text_licence"] for x in op9_licences.scan_licences(table(spark, texts), none).collect()} == {None}


def test_packing(spark):
    rng = random.Random(10)
    texts = [prose(rng, rng.choice([1, 20, 90, 200, 400])) for _ in range(60)] + EDGES + ["a  b\n\n c\t d ", " lead", "it's 12 o'clock's", "tail ", "日本語 テキスト", "x" * 9000]
    r = op10_packing.pack(table(spark, texts), TOKENIZER).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    by, bins = defaultdict(list), defaultdict(list)
    for x in r:
        by[x["doc_id"]].append(x)
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    total = 0
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        at = 0
        for k, x in enumerate(sorted(by[i], key=lambda x: x["piece"])):
            part = ids[at : at + x["length"]]
            assert (x["piece"], x["start"], x["ids_crc32"]) == (k, at, zlib.crc32(b"".join(v.to_bytes(4, "little") for v in part)))
            assert x["length"] == 1024 or k == 0
            at += x["length"]
        assert at == len(ids)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-total // 1024) * 1.08 + 1


def test_encoder_equals_the_library(spark):
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    ours, theirs = op10_packing.Encoder(open(TOKENIZER, encoding="utf-8").read()), Tokenizer.from_file(TOKENIZER)
    for t in docs:
        assert ours.encode(t) == ours.packed(theirs.encode(t, add_special_tokens=False).ids)


def test_components_and_ranks(spark):
    rng = random.Random(11)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    assert all(got[x] == top(x) for x in got) and set(got) >= {x for a, b in edges for x in (a, b) if a != b}
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    ranks = defaultdict(list)
    for r in gapless_rank(df, ["k"], "id", 500).collect():
        ranks[r["k"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(12)
    leak = prose(rng, 30, "abcde")
    texts = [prose(rng, 60) + ". " + prose(rng, 30) + "." for _ in range(20)]
    shared = ". ".join(prose(rng, 9) for _ in range(7)) + "."
    texts += [texts[0], texts[1] + " more", "1234 !!", None, texts[2] + " " + leak, texts[3] + "\n" + shared, texts[4] + "\n" + shared]
    docs = table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, seen = str(tmp_path), {}
    docs = spark.read.parquet(sf + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    ids = {k: {r["doc_id"] for r in v} for k, v in seen.items()}
    assert ids["language_id"] == set(range(27)) - {22, 23}
    assert ids["jaccard_join"] == ids["language_id"] - {20, 21}
    kept = {r["doc_id"]: r["text"] for r in seen["substring_dedup"]}
    assert kept == {d: t for d, t in brute_substring_dedup((r["doc_id"], r["text"]) for r in seen["jaccard_join"]).items() if t.strip()}
    assert shared in kept[25] and len(kept.get(26, "")) < 0.2 * len(texts[26]) and all(r["n_chars"] == len(r["text"]) for r in seen["substring_dedup"])
    assert ids["decontamination"] == set(kept) - {24}
    assert ids["packing"] == ids["decontamination"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == ids["packing"]


def test_wrapped_licence_text_is_no_claim(spark):
    isc = op9_licences.TEXTS["ISC"]
    wrapped = isc.replace("that the above copyright notice", "that the above\ncopyright notice")
    assert wrapped != isc
    claims = [wrapped.replace("Copyright (c) <year> <holder>", c) for c in ("Copyright (c) 2020 Jane Doe", "Copyright 2020, Jane Doe", "(c) 2020 Jane Doe", "© Jane Doe", "Copyright Jane Doe")]
    texts = [wrapped, *claims, "a\n(c) keep this clause", "a"]
    got = {r["doc_id"]: r for r in op9_licences.scan_licences(table(spark, texts)).collect()}
    assert [got[i]["text_licence"] for i in range(6)] == ["ISC"] * 6
    assert got[6]["digest"] != got[7]["digest"]


def test_whole_licences_and_wraps(spark):
    names = sorted(op9_licences.TEXTS)
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-3-Clause", "MIT"} <= set(names)
    texts = [op9_licences.TEXTS[n] for n in names] + [re.sub(r"[ \t]*\n(?!\n)", "\n", op9_licences.TEXTS[n]).upper() for n in names] + ["x " + op9_licences.TEXTS[n] for n in names]
    got = {r["doc_id"]: r["text_licence"] for r in op9_licences.scan_licences(table(spark, texts)).collect()}
    assert [got[i] for i in range(3 * len(names))] == names + names + [None] * len(names)


def test_rows_of_one_or_no_id_are_documents_of_their_own(spark):
    licence = op9_licences.TEXTS["MIT"]
    df = table(spark, [licence, "a b c d e f g h i j"]).unionByName(table(spark, ["Released under the MIT License."]))
    df = df.unionByName(table(spark, ["a b c d e f g h i j", None]).withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text_licence"] or "", r["n_notices"]) for r in op9_licences.scan_licences(df).collect())
    assert got == [(False, 0, "MIT", 0), (False, 0, "MIT", 1), (False, 1, "", 0), (True, 0, "", 0), (True, 0, "", 0)]
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, "")], "item_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_hit"], r["n_items"]) for r in op3_decontamination.decontaminate(df, bench).collect())
    assert got == [(False, 0, 0, 0), (False, 0, 0, 0), (False, 1, 10, 1), (True, 0, 0, 0), (True, 0, 10, 1)]


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    rng = random.Random(14)
    text = prose(rng, 80) + "."
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, None), (4, ""), (5, prose(rng, 70)), (6, "x" * 200_000), (7, prose(rng, 60_000))]
    names = ["_lang", "_score", "_n_removed", "_row", "_id", "rank", "h", "c", "kept", "words"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for some in (docs, docs.where("false")):
        now = some
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            found = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
                now = spark.createDataFrame(found, out.schema)
            if some is docs:
                ids = {r["doc_id"] for r in found}
                assert {1, 5, 7} <= ids and (name == "language_id") <= (3 not in ids)
            else:
                assert not found


def test_chats_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op6_chat.digests(op6_chat.format_chats(rows)).count() == 0


def fewest_bins(sizes, capacity):
    """The fewest bins that hold the sizes, by trying every way."""
    best, sizes = [len(sizes)], sorted(sizes, reverse=True)

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + sizes[k] <= capacity:
                rest = list(bins)
                rest.remove(b)
                place(k + 1, [*rest, b + sizes[k]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best[0]


def test_histogram_packing_by_brute_force():
    rng, extra = random.Random(15), 0
    for _ in range(300):
        capacity = rng.randint(6, 20)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        bins, ranks = defaultdict(list), defaultdict(list)
        for size, r0, r1, base, per, offset in op10_packing.pack_histogram(Counter(sizes), capacity):
            for rank in range(r0, r1):
                ranks[size].append(rank)
                bins[base + (rank - r0) // per].append((offset + (rank - r0) % per * size, size))
        assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in Counter(sizes).items()}
        for parts in bins.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at <= capacity
        fewest = fewest_bins(sizes, capacity)
        assert fewest <= len(bins) <= fewest + 1
        extra += len(bins) - fewest
    assert extra <= 30
