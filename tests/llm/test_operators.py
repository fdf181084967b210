"""Each operator against a brute-force version, a round trip or held-out accuracy, and its edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import chat_format, chroma, decontaminate, html_text, near_dedup, packing, queries, secret_scan, sharding, token_store, toxicity
from gristmill.llm.tokens import encoder, vocabulary

SCHEMA = "doc_id long, text string, lang string, key string, shard string, spans string, score string"


def docs(spark, rows):
    """Rows of (doc_id, text) with more columns, some named as the operators' own."""
    return spark.createDataFrame([(i, t, "en", "k", "s", "p", "x") for i, t in rows], SCHEMA)


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(400)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Exact copies, near copies, shared passages, empty, null, short and very long texts, repeated rows, a null id."""
    out, base, shared = [], words(120, 1), words(60, 2)
    for i in range(60):
        own = words(100, 100 + i)
        if i < 15:
            own = base[:]
            for k in range(i % 5):
                own[(i * 13 + k * 29) % 120] = f"x{i}"
        elif i < 30:
            own = shared + own[:50]
        out.append((i, " ".join(own)))
    out += [(100, out[0][1]), (101, out[0][1].upper()), (102, ""), (103, None), (104, "  \n\t"), (105, "one two"), (106, "ONE  two"), (107, " ".join(words(20_000, 7)))]
    return [*out, (7, out[7][1]), (None, out[0][1])]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 7 ---------------------------------------------------------------------------------------------------------------


def sets(text):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def brute_components(rows):
    own = {i: sets(t) for i, t in rows if i is not None}
    parent = {i: i for i in own}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in own:
        for b in own:
            if a < b and own[a] and 3 * len(own[a]) <= 4 * len(own[b]) and 3 * len(own[b]) <= 4 * len(own[a]) and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(own[i]), top(i)) for i in own}


def test_near_duplicates(spark, corpus):
    got = near_dedup.near_duplicates(docs(spark, corpus)).collect()
    want = brute_components(corpus)
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def group_of_copies(n, seed, edits):
    """Copies of one text, with so many words at random places replaced that some are linked and some are just short of it."""
    r = random.Random(seed)
    base = words(120, seed)
    out = []
    for i in range(n):
        own = base[:]
        for k in r.sample(range(120), r.randrange(edits)):
            own[k] = f"{seed}x{i}y{k}"
        out.append(" ".join(own))
    return out


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Buckets larger than a block, of one component and of several, give what brute force gives."""
    rows = list(enumerate(group_of_copies(60, 3, 9) + group_of_copies(30, 4, 4) + [" ".join(words(50, 60 + i)) for i in range(10)]))
    want = brute_components(rows)
    assert 2 < len({c for _, c in want.values()}) < 60
    for block in (near_dedup.BLOCK, 4):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
        assert got == want


def test_near_duplicates_of_ids_with_two_texts(spark):
    """Rows of one id are one document, linked with what each of its texts is linked with."""
    a, b = words(100, 21), words(100, 22)
    near = lambda own, k: " ".join([*own[:-1], f"z{k}"])
    rows = [(5, " ".join(b)), (5, " ".join(a)), (6, near(a, 1)), (7, near(b, 2)), (8, " ".join(a)), (3, " ".join(words(90, 23))), (9, " ".join(words(90, 23))), (9, near(a, 3))]
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {(i, 3) for i in (3, 5, 6, 7, 8, 9)}


def test_near_duplicates_recall_on_the_table(spark):
    """Each component of the whole table is that of brute force."""
    table = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    want = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table).collect()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 103), (101, 103), (102, 101)]
    got = dict(near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(1, 51)) and {got[i] for i in (101, 102, 103)} == {100}


def test_signature_estimates_similarity():
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = near_dedup.signature(np.unique(x[:2000])), near_dedup.signature(np.unique(x[500:2500]))
    assert abs((a == b).mean() - 0.6) < 0.15


# 3 and 8 ---------------------------------------------------------------------------------------------------------


def library(text, end, name="word_bpe_49k.json"):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [end]


STRANGE = ["Hello, WORLD. it's 12ab\tç̧ Σας\x1cx\x85y z 'll don't <|endoftext|> ÀÉß, a.b.c ...", "a" * 5000, "", None, "\n\n  x ", "That*** it.&&& IT.'*** él, 日本 ''s ok' x__ \u2028y"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name, monkeypatch):
    """Ids are the library's for every vocabulary that it reads, also when words are forgotten and learned again."""
    from gristmill.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 1_000)
    for width in (None, 4):
        e = tokens.Encoder(vocabulary(name), width)
        for _ in range(2):
            for text, own in zip(STRANGE, e.encode_all(STRANGE), strict=True):
                assert bytes(e.wide(own)) == np.array(library(text, 0, name)[:-1], "<u4").tobytes()
                assert e.encode(text) == own
    assert tokens.Encoder(vocabulary(name)).width == 2
    with pytest.raises(ValueError, match="fit"):
        tokens.Encoder(vocabulary(name), 1)


def test_encoder_on_the_table():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    for text, own in zip(texts, encoder(vocabulary(), 4).encode_all(texts), strict=True):
        assert own == np.array(library(text, 0)[:-1], "<u4").tobytes()


def test_token_store_of_a_hot_id(spark, tmp_path):
    """Rows of one id are spread over files, and another vocabulary is stored as well."""
    rows = [(None, f"text {k}") for k in range(400)] + [(1, "same")] * 400
    manifest, dictionary = token_store.write_tokens(docs(spark, rows).repartition(4), f"file://{tmp_path}/t", tokenizer=vocabulary("byte_bpe_50k.json"))
    got = token_store.read_tokens(manifest, dictionary).orderBy("start").collect()
    want = Counter((i, zlib.crc32(np.array(library(t, 1, "byte_bpe_50k.json"), "<u4").tobytes())) for i, t in rows)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()


def test_pack(spark, corpus):
    rows = packing.pack(docs(spark, corpus), capacity=256).collect()
    own = Counter()
    for i, t in corpus:
        ids = library(t, 0)
        own.update((i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes())) for k in range(0, len(ids), 256))
    assert Counter(tuple(r)[:5] for r in rows) == own
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("histogram", [{1500: 100}, {700: 90, 30: 5}, {2048: 3, 1: 7}, {1025: 50, 1023: 30, 513: 90, 511: 10}, {k: k % 7 + 1 for k in range(1, 2048, 3)}])
def test_plan_covers_and_is_near_the_bound(histogram):
    planned, bound = packing.plan(histogram)
    got = Counter()
    for own, times in planned:
        assert sum(n * k for n, k in own) <= 2048
        for n, k in own:
            got[n] += k * times
    assert got == Counter(histogram)
    used = sum(t for _, t in planned)
    assert bound - 1e-6 <= used <= bound * 1.03 + 2


def test_token_store(spark, corpus, tmp_path):
    manifest, dictionary = token_store.write_tokens(docs(spark, corpus), f"file://{tmp_path}/t")
    rows = sorted((tuple(r) for r in token_store.read_tokens(manifest, dictionary).collect()), key=lambda r: r[1])
    start = 0
    for (i, t), r in zip(sorted(corpus, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), rows, strict=True):
        ids = np.array(library(t, 1), "<u4")
        assert r == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    first = manifest.orderBy("first_id").first()
    assert token_store.read_document(first["file"], 102, dictionary).tolist() == [1] or manifest.count() > 1
    with pytest.raises(ValueError, match="dictionary"):
        token_store.read_document(first["file"], 1, b"other")
    assert token_store.store(docs(spark, [])).count() == 0


def test_token_store_writes_few_parts(spark, tmp_path):
    """Many small files: one part of manifest and a few of the result, since a part starts programs beside the executor."""
    rows = [(k, f"text {k % 9}") for k in range(800)]
    ids = {t: library(t, 1) for _, t in rows[:9]}
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        manifest, dictionary = token_store.write_tokens(docs(spark, rows), f"file://{tmp_path}/t")
        back = token_store.read_tokens(manifest, dictionary)
        assert (manifest.count(), len(manifest.inputFiles()), back.rdd.getNumPartitions()) == (40, 1, 1)
        got = back.orderBy("start").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t in rows]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()


# 10 --------------------------------------------------------------------------------------------------------------


def test_shards(spark, corpus):
    rows = [*corpus, *((1000 + i, "hot text " * 20) for i in range(2000))]
    got = sharding.shard(docs(spark, rows), part_bytes=2_000).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((i is None, i or 0, t or "") for i, t in rows)
    size = lambda t: len((t or "").encode()) + 16
    load, slots = Counter(), {}
    for r in got:
        load[r["shard"]] += size(r["text"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(load.values()) / 40
    assert max(load.values()) <= mean + 2 * max(size(t) for _, t in rows)
    even = sharding.shard(docs(spark, [(i, f"text {i:06d}") for i in range(4000)])).groupBy("shard").count().collect()
    assert len(even) == 40 and max(r["count"] for r in even) - min(r["count"] for r in even) <= 3
    assert sharding.shard(docs(spark, [])).count() == 0


@pytest.mark.parametrize("part_bytes", [sharding.PART_BYTES, 3_000])
def test_shards_of_repeated_rows(spark, part_bytes):
    """A row that is there very often, with one id or none, is cut by its place; with few shards and many, with parts and without."""
    rows = [(7, "same row")] * 3000 + [(None, "no id")] * 500 + [(i, f"text {i}") for i in range(200)] + [(1, None)]
    for shards in (1, 7):
        got = sharding.shard(docs(spark, rows), shards=shards, part_bytes=part_bytes).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
        load, slots = Counter(), {}
        for r in got:
            load[r["shard"]] += len((r["text"] or "").encode()) + 16
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert len(load) == shards and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(load.values()) - min(load.values()) <= 60


# 9 ---------------------------------------------------------------------------------------------------------------


CONTRACT = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)


def brute_spans(text, rules=None):
    """The contract's three rules as the test writes them, and the library's others."""
    out = []
    for k, (kind, pattern, group, least) in enumerate([*CONTRACT, *((r.kind, r.pattern, r.group, r.least) for r in secret_scan.RULES[3:])]):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "", re.A) if len(m[group]) >= least]
    return sorted(out)


SECRETS = [
    "password=hunter22 token: 'abcdef' Api_Key = \"zzzzzzz\" secret: token = abcdefgh apikey:short PASSWD='x_y.z-1'",
    "é AKIA" + "A1" * 8 + " AKIA123 " + "deadbeef" * 3 + " " + "deadbeef" * 2,
    "ghp_" + "a1" * 18 + " sk_live_" + "b2" * 10 + " -----BEGIN RSA PRIVATE KEY----- xoxb-1234567890-z",
    "token=token=abcdefgh pass word", "PASSWORD=\u212aabcdef passWORD=abcdefg to\u212aen=abcdefgh", "", None, "plain text", "𝔘𝔫 password=𝔘 secret = aaaaaa" + "f" * 30,
]


def test_secrets(spark):
    rows = [*enumerate(SECRETS), (0, SECRETS[0]), (None, SECRETS[1])]
    for r in secret_scan.scan(docs(spark, rows)).collect():
        assert [tuple(s) for s in r["spans"]] == brute_spans(r["text"])
    assert secret_scan.scan(docs(spark, [])).count() == 0


def test_secrets_of_very_long_texts(spark):
    """Very many matches, overlapping ones and code points beyond 16 bits, over several blocks and steps."""
    parts = [f"𝔘 word{k} password=pw{k:06d} AKIA{k:020d} {'𝔘é' * (k % 50)} token={'0123456789abcdef' * 2}" for k in range(3000)]
    text = " ".join(parts)
    found = secret_scan.scan(docs(spark, [(1, text), (2, "x" * 2_000_000)])).select("doc_id", "spans", secret_scan.redact(F.col("text"), F.col("spans")).alias("red"))
    got = {r["doc_id"]: r for r in found.collect()}
    want = brute_spans(text)
    assert [tuple(s) for s in got[1]["spans"]] == want and len(want) > 9000 and got[2]["red"] == "x" * 2_000_000
    out, at = [], 0
    for start, _, end, kind in want:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    assert got[1]["red"] == "".join(out) + text[at:]


def test_redact(spark):
    found = secret_scan.scan(docs(spark, enumerate(SECRETS))).select("text", "spans", secret_scan.redact(F.col("text"), F.col("spans")).alias("red"))
    for r in found.collect():
        if not r["spans"]:
            assert r["red"] == r["text"]
        else:
            assert not [x for x in brute_spans(r["red"]) if x[3] in ("access", "hex")]
    assert secret_scan.redact.__doc__


def test_trigram_queries_are_necessary():
    def holds(q, own):
        return q is None or (q in own if isinstance(q, str) else (all if q[0] == "and" else any)(holds(x, own) for x in q[1]))

    for rule in secret_scan.RULES:
        for text in SECRETS:
            for m in re.finditer(rule.pattern, text or "", re.A):
                low = m[0].lower()
                assert holds(secret_scan.trigram_query(rule.pattern), {low[k : k + 3] for k in range(len(low))})
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is None
    assert secret_scan.trigram_query("ab[0-9]+cdef") == ("and", ("cde", "def"))


# 2 ---------------------------------------------------------------------------------------------------------------


TRICKY = ["</s>[INST] ok [/INST]", "a\\b \\<|im_end|> <|im_sep|>", "<<SYS>>x<</SYS>>", "", "\\\\[INST]\\", "<|<|im_start|>", "line\nline"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text) for c in (1, 2) for t, (role, text) in enumerate((r, x) for x in TRICKY for r in ("user", "assistant", "we\\ird <s>"))]
    rows += [(3, None, None, None), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 1, "user", "y")]
    df = spark.createDataFrame([(*r, "z", "f") for r in rows], "conv_id long, turn long, role string, text string, turns string, formatted string")
    made = chat_format.format_chat(chat_format.canonical(df))
    for r in made.collect():
        assert sum(m["chars"] for m in r["mask"]) == len(r["formatted"])
    for r in chat_format.read_back(made).collect():
        own = sorted(((t is not None, t or 0, a or "", b or "") for c, t, a, b in rows if c == r["id"]))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [x[2:] for x in own]
        assert r["loss_text"] == "".join(b for _, _, a, b in own if a == "assistant")
    plain = made.where("id = 1").first()["formatted"]
    inner = re.sub(chat_format.MARKS, "", plain)
    assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", inner)
    assert chat_format.canonical(df.where("false")).count() == 0


def test_chat_of_long_conversations_and_other_ids(spark):
    """A conversation of very many turns and very long texts, with the id under another name and a clashing column; the mask tells where loss is."""
    rows = [(7, t, "assistant" if t % 2 else "user", f"𝔘 {t} <|im_end|> " + "é\\" * (t % 40)) for t in range(3000)] + [(8, 0, "assistant", "x𝔘\n" * 200_000), (8, 0, "user", "")]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "thread long, turn long, role string, text string, mask string, blocks string")
    made = chat_format.format_chat(chat_format.canonical(df, "thread"))
    got = {r["id"]: r for r in chat_format.read_back(made).collect()}
    for c in (7, 8):
        own = [x for x in rows if x[0] == c]
        assert got[c]["loss_text"] == "".join(x[3] for x in own if x[2] == "assistant")
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(x[2], x[3]) for x in sorted(own)]
    off = made.withColumn("mask", F.transform("mask", lambda m: F.struct(m["chars"], (~m["loss"]).alias("loss"))))
    assert chat_format.read_back(off).where("id = 8").first()["loss_text"].startswith("<|im_start|>")


def test_chat_records(spark):
    rows = [
        (1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"extra":{"x":1}}'),
        (2, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'),
        (3, '{"instruction":"a","input":"c","output":"b"}'), (4, '{"instruction":"a","output":"b"}'),
        (5, '{"prompt":"a","completion":"b"}'), (6, '{"question":"a","answer":"b"}'), (7, "{broken"), (8, '{"q":1}'), (9, None),
    ]
    got = {r["id"]: r for r in chat_format.canonical_records(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect()}
    for i in (1, 2, 4, 5, 6):
        assert [tuple(t) for t in got[i]["turns"]] == [("user", "a"), ("assistant", "b")]
    assert got[3]["turns"][0]["text"] == "a\n\nc" and all(got[i]["turns"] is None for i in (7, 8, 9))
    nested = spark.createDataFrame([(1, [("user", "a")])], "id long, messages array<struct<role:string,content:string>>")
    assert chat_format.layout_of(nested).name == "messages"
    assert chat_format.canonical(nested, "id").first()["turns"][0]["text"] == "a"
    with pytest.raises(ValueError, match="no layout"):
        chat_format.layout_of(spark.range(1))


# 1 ---------------------------------------------------------------------------------------------------------------


ITEM = "A train travels 60 km in 2 hours while Anna waits at the station near the river; after 60 km Anna leaves and walks 5 miles home before the sun sets."


def test_contaminated(spark):
    items = spark.createDataFrame([(1, ITEM, "e"), (2, "short one", "e"), (3, None, "e")], "item_id long, text string, doc_id string")
    other = ITEM.replace("60", "75").replace("Anna", "Berta")
    uneven = ITEM.replace("60", "75", 1).replace("Anna", "Berta", 1)
    filler = " ".join(words(40, 5))
    rows = [(1, f"{filler} {ITEM} {filler}"), (2, f"{filler}. {other} {filler}"), (3, f"{filler}. {uneven}"), (4, filler), (5, None), (6, ""), (7, ITEM.upper()), (1, f"{filler} {ITEM} {filler}"), (None, ITEM)]
    got = {r["doc_id"]: r for r in decontaminate.contaminated(docs(spark, rows), items).collect()}
    assert got[1]["kind"] == "exact" and got[2]["kind"] == "reparameterised" and got[2]["n_changed"] == 2 and None in got
    assert not {3, 4, 5, 6} & set(got)
    assert decontaminate.contaminated(docs(spark, []), items).count() == 0
    assert decontaminate.contaminated(docs(spark, rows), items.where("false")).count() == 0


def test_contaminated_against_brute_force(spark, folder, monkeypatch):
    """On the whole tables, with a very long text and planted re-parameterised copies: all and only documents that hold an item; joins without a broadcast give the same."""
    items = queries.table(spark, folder, "benchmark")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").casefold())) + " "
    wanted = {r["item_id"]: plain(r["text"]) for r in items.collect()}
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, folder, "documents").select("doc_id", "text").collect()]
    first = items.orderBy("item_id").first()["text"]
    rows.append((900_000, " ".join(words(200_000, 9)) + " " + first))
    want = {(i, k) for i, t in rows for k, own in wanted.items() if own in plain(t)}
    df = docs(spark, rows)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, items).where("kind = 'exact' AND coverage = 1").collect()}
    assert got == want and len(want) > 3
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    monkeypatch.setattr(decontaminate, "MOST_HASHES", 0)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, items).where("kind = 'exact' AND coverage = 1").collect()} == want


def test_contaminated_items_without_template_windows(spark):
    """Short items and items dense with numbers and names are found verbatim."""
    dense = "Do Tom, Ann, Bob and Eve have 12, 15, 18 and 21 marbles?"
    items = spark.createDataFrame([(1, "What is the capital of France?"), (2, dense), (3, "12 apples"), (4, None), (5, "...")], "item_id long, text string")
    filler = " ".join(words(40, 5))
    rows = [(1, f"{filler}. What is the capital of France? {filler}"), (2, f"{filler} {dense} {filler}"), (3, f"room 5 12 apples {filler}"), (4, filler), (5, "12 pears")]
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.contaminated(docs(spark, rows), items).collect()}
    assert got == {(1, 1, "exact"), (2, 2, "exact"), (3, 3, "exact")}


def test_contaminated_in_other_case(spark):
    """Copies in other case are found, also with other numbers in them; uneven ones aren't."""
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    other = ITEM.replace("60", "75")
    uneven = ITEM.replace("60", "75", 1).upper()
    rows = [(1, ITEM.upper()), (2, ITEM.lower()), (3, ITEM.title()), (4, other.upper()), (5, other.lower()), (6, uneven)]
    got = {r["doc_id"]: (r["kind"], r["n_changed"]) for r in decontaminate.contaminated(docs(spark, rows), items).collect()}
    assert got == {1: ("exact", 0), 2: ("exact", 0), 3: ("exact", 0), 4: ("reparameterised", 1), 5: ("reparameterised", 1)}


def test_contaminated_with_values_of_other_lengths(spark):
    long = "the old farmer counts his red apples near a barn where 65 grey geese walk along slowly toward cold quiet water"
    anna = "early this morning the baker told Anna that fresh bread would not be ready before noon because of rain"
    items = spark.createDataFrame([(1, long), (2, anna)], "item_id long, text string")
    rows = [(1, long.replace("65", "sixty five")), (2, long.replace("65", "1 000")), (3, long.replace("65", "one hundred and five")), (4, anna.replace("Anna", "Anna Maria"))]
    rows += [(5, " ".join(words(40, 5)))]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, rows), items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 2)}


def test_long_item_pools_neighbouring_distances(spark):
    """15 windows; 4 of them agree at one distance and 3 at the next."""
    own = words(22, 10)
    assert len(set(own)) == 22
    items = spark.createDataFrame([(1, " ".join(own))], "item_id long, text string")
    rows = [(1, " ".join([*own[:11], "new", "value", *own[12:]])), (2, " ".join([*own[:11], *words(200, 11), *own[12:]]))]
    assert [r["doc_id"] for r in decontaminate.contaminated(docs(spark, rows), items).collect()] == [1]


def test_contaminated_without_hash_set(spark, monkeypatch):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(1, f"x y z. {ITEM}"), (2, "nothing here " * 10)]
    want = decontaminate.contaminated(docs(spark, rows), items).collect()
    monkeypatch.setattr(decontaminate, "MOST_HASHES", 1)
    assert decontaminate.contaminated(docs(spark, rows), items).collect() == want != []


# 5 ---------------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        own, bad = words(40, i), r.random() < 0.3
        if bad:
            own[5:5] = [r.choice(["vile", "scummy"]), r.choice(["muslim", "gay", "women"])] if r.random() < 0.8 else ["vile"]
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad), "q"))
    labels += [(None, 1, "q"), (5, None, "q")]
    rows += [(5000, None), (5001, ""), (5002, "a neutral text on muslim women and gay men"), (None, "vile")]
    table = spark.createDataFrame(labels, "doc_id long, toxic int, score string")
    got = toxicity.classify(docs(spark, rows), table).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    score = {x["doc_id"]: x["score"] for x in got}
    held = [(i, y) for i, y, _ in labels if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((score[i] >= 0.5) == bool(y) for i, y in held) >= 0.95 * len(held)
    assert score[5002] < 0.5 < score[None]
    assert {x["score"] for x in toxicity.classify(docs(spark, rows), table.where("false")).collect()} == {0.0}


def test_toxicity_of_odd_labels(spark, monkeypatch):
    """One class only, ids that many rows repeat, empty tables, very long texts."""
    rows = [(1, f"text {k}") for k in range(300)] + [(i, "vile " * 3 if i % 2 else "kind words") for i in range(2, 40)] + [(50, "vile " * 300_000), (51, None)]
    table = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    all_toxic = toxicity.classify(docs(spark, rows), table.where("toxic = 1")).select("score").distinct().collect()
    assert len(all_toxic) == 1 and all_toxic[0][0] > 0.9
    seen = []
    real = toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, name: seen.append(out := real(df, name)) or out)
    got = toxicity.classify(docs(spark, rows), table, most=20).collect()
    assert len(got) == len(rows) and seen[0].count() <= 20
    assert toxicity.classify(docs(spark, []), table).count() == 0


def test_fit_is_at_its_optimum():
    """The fitted weights against plain gradient descent on the same objective, written out densely."""
    r = np.random.default_rng(2)
    x = (r.random((200, 6)) < 0.4).astype(float)
    y = (x[:, 0] + r.random(200) > 0.9).astype(float)
    d = np.zeros((200, 6))
    d[:, 1] = 1
    own = [np.flatnonzero(row).tolist() for row in x]
    b, w = toxicity.fit(y.astype(int).tolist(), own, [{1: 1}] * 200, 6)

    def objective(w, b):
        z = x @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + toxicity.RIDGE * (w @ w) / 2 + toxicity.FAIRNESS * np.mean((d @ w) ** 2) / 2

    v, c = np.zeros(6), 0.0
    for _ in range(20_000):
        g = 1 / (1 + np.exp(-(x @ v + c))) - y
        v, c = v - 0.5 * (x.T @ g / 200 + toxicity.RIDGE * v + toxicity.FAIRNESS * d.T @ (d @ v) / 200), c - 0.5 * g.mean()
    assert objective(w, b) <= objective(v, c) * 1.02 + 1e-3


def test_fairness_penalty_lowers_identity_weights():
    own = [[0, 1]] * 30 + [[2]] * 70
    labels, swaps = [1] * 30 + [0] * 70, [{1: 1}] * 100
    free = toxicity.fit(labels, own, [], 3)[1]
    fair = toxicity.fit(labels, own, swaps, 3)[1]
    assert abs(fair[1]) < 0.25 * abs(free[1]) and fair[0] > 1


# 6 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a  b<br>c<p>d <b>e</b>", "a b\nc\n\nd e"),
        ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>tail", "- one\n- two\n  3. x\n  4. y\n\ntail"),
        ("<table><tr><th>Name<th>N<tr><td>Al<td>1<tr><td>Barbara<td>22</table>", "Name     N\nAl       1\nBarbara  22"),
        ("<table><tr><td colspan=2>wide<td>c<tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e</table>", "wide   c\na  b  c\n   d  e".replace("wide   c", "wide  c")),
        ("<head><title>t</title></head><script>var x='<p>no</p>'</script><div hidden>h</div><i style='display: none'>n</i>yes &amp; &lt;no&gt;", "yes & <no>"),
        ("<pre>  a\n   b</pre>c", "  a\n   b\n\nc"),
        ("<!-- x -->text", "text"), ("", ""), (None, ""), ("a < b", "a < b"), ("<div>" * 2000 + "deep", "deep"), ("</p></div>x", "x"),
    ],
)
def test_html(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>t</title><p>Hello", "Hello"), ("<head>\n<meta charset=x>\nHello <b>you</b>", "Hello you"), ("<head><title>t</title><header>top</header>x", "top\nx"),
        ("<head><noscript><p>no</noscript><template><p>no</template><style>p{}</style><body>yes", "yes"), ("<head><title>t</title></head>yes", "yes"),
    ],
)
def test_html_open_head(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> holds", "so x=2 holds"),
        ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><style/><text>North</text><text>South</text></svg> tail", "North South tail"),
        ("<p>Pick <select><optgroup label=Fruit><option>red apple<option>pear</select> now", "Pick Fruit red apple pear now"),
        ("a<xmp>  <b>raw</b> &amp;</xmp>c", "a\n\n  <b>raw</b> &amp;\n\nc"), ("<desc>seen</desc>", "seen"),
    ],
)
def test_html_formulas_drawings_choices(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<style>.x{display:none} #y , p.z {visibility:hidden}</style><p class='a x'>no<p id=y>no <b style='visibility:visible'>yes</b><p class=z>no<div class=z>seen</div>", "yes\n\nseen"),
        ("<style>@import 'a'; @media print{.q{display:none}} @media screen{.s{display:none}} /* .c{display:none} */ .c{color:red}</style><p class=q>a<p class=s>no<p class=c>b", "a\n\nb"),
        ("<style>p{display:none} .v{display:block}</style><p>no<p class=v>yes<p class=v hidden>shown by its class", "yes\n\nshown by its class"),
        ("<details><summary>Sum</summary>no</details><details open><summary>S2</summary>yes</details><dialog>no</dialog><dialog open>d</dialog>", "Sum\nS2\nyes\nd"),
        ("<table><tr><td style='visibility:hidden'>aa<td>b<tr><td>c<td>d</table>", "   b\nc  d"),
        ("<a title='x > y'>t</a> a < b", "t a < b"), ("<b x='>'>u</b><b x='>v", "uv"),
    ],
)
def test_html_styles_and_quotes(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize("part", ["<a b ", '<a "', '<a x="', '<a x=">" ', "<!-- ", "<", "</a ", "<div>", "<li>", "<style>a{", "<style>.a{display:none}", "<b =\" "])
def test_html_broken_pages_take_time_in_proportion(part):
    import time

    t = time.process_time()
    html_text.visible_text(part * (300_000 // len(part)))
    assert time.process_time() - t < 20


class Plain(HTMLParser):
    """Another reader of pages, by the standard library: the words outside of what is never shown."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attributes):
        names = dict(attributes)
        if self.off or tag in ("head", "script", "style", "template", "noscript") or "hidden" in names or "none" in (names.get("style") or ""):
            self.off += tag not in html_text.VOID

    def handle_endtag(self, tag):
        self.off -= bool(self.off)

    def handle_data(self, data):
        if not self.off:
            self.words += data.split()


def test_html_words_equal_another_readers():
    """On well-formed pages made at random, both readers see the same words in the same order, list marks aside."""
    r = random.Random(3)

    def make(depth):
        out = []
        for _ in range(r.randrange(1, 5)):
            kind = r.choice(["text", "text", "p", "div", "span", "b", "ul", "table", "hidden", "script", "section"]) if depth else "text"
            if kind == "text":
                out.append(" ".join(r.choice(["w1", "a&amp;b", "caf&eacute;", "x &lt; y", "zz"]) for _ in range(r.randrange(1, 5))))
            elif kind == "ul":
                out.append("<ul>" + "".join(f"<li>{make(depth - 1)}</li>" for _ in range(2)) + "</ul>")
            elif kind == "table":
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{r.randrange(99)}x</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            elif kind == "hidden":
                out.append(f"<div {r.choice(['hidden', 'style=display:none'])}>{make(depth - 1)}</div>")
            elif kind == "script":
                out.append("<script>var no = '<p>';</script>")
            else:
                inner = make(0) if kind in ("p", "span", "b") else make(depth - 1)
                out.append(f"<{kind} class='c'>{inner}</{kind}>")
        return " ".join(out)

    for _ in range(150):
        page = f"<html><head><title>t</title></head><body>{make(3)}</body></html>"
        other = Plain()
        other.feed(page)
        assert [w for w in html_text.visible_text(page).split() if w != "-"] == other.words


def test_html_table(spark):
    df = spark.createDataFrame([(1, "<p>x", "old"), (1, "<p>x", "old"), (2, None, "old")], "page_id long, html string, text string")
    assert sorted(tuple(r) for r in html_text.extract(df).select("page_id", "text").collect()) == [(1, "x"), (1, "x"), (2, "")]
    assert html_text.extract(df.where("false")).count() == 0
    long = spark.createDataFrame([(1, "<p>" + "word <b>x</b> " * 100_000)], "page_id long, html string")
    assert len(html_text.extract(long).first()["text"]) == 699_999


# 4 ---------------------------------------------------------------------------------------------------------------


def tune(notes, rate=8000, seconds=0.25):
    t = np.arange(int(rate * seconds)) / rate
    return np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (n / 12) * t) + 0.4 * np.sin(2 * np.pi * 880 * 2 ** (n / 12) * t) for n in notes])


def test_chroma_aligns(spark):
    audio = chroma.Audio(8000, 1024, 256)
    r = random.Random(1)
    song = tune([r.randrange(24) for _ in range(30)])
    noisy = song[20 * 256 :] + np.random.default_rng(0).normal(0, 0.05, len(song) - 20 * 256)
    other = tune([r.randrange(24) for _ in range(30)])
    rows = [(0, song), (1, noisy), (2, other), (3, song), (4, []), (5, None), (6, [0.0] * 8000), (None, song)]
    df = spark.createDataFrame([(i, None if x is None else [float(v) for v in x]) for i, x in rows], "id long, samples array<double>")
    members, matches = chroma.align(df, "id", "samples", audio)
    of = dict(members.collect())
    assert of[0] == of[3] == 0 and of[4] == 4 and of[5] == 5 and None not in of
    got = {(m["query_class"], m["match_class"]): m for m in matches.collect()}
    assert (0, 1) in got and (0, 2) not in got and got[0, 1]["offset"] == -20
    e = chroma.fingerprint(np.array(song), audio)[0].view(np.int32)
    n = chroma.fingerprint(np.array(noisy), audio)[0].view(np.int32)
    best = min(range(-100, 100), key=lambda k: chroma.bit_error(e, n, k))
    assert best == -20


def test_chroma_recall_against_brute_force(spark, folder, monkeypatch):
    """Clips of the table with noisy and shifted copies, over several blocks: what is given meets the rule, and recall over all offsets is high."""
    monkeypatch.setattr(chroma, "BLOCK", 3_000)
    r = np.random.default_rng(5)
    clips = [np.array(x["embedding"]) for x in spark.read.parquet(f"{folder}/embeddings.parquet").select("embedding").limit(150).collect()]
    noisy = [x + r.normal(0, 0.02, len(x)) for x in clips]
    shifted = [np.r_[x[1:], r.normal(0, 0.12, 1)] for x in clips[:50]]
    samples = [*clips, *noisy, *shifted, *clips[:20]]
    rows = spark.createDataFrame([(k, x.tolist(), "c") for k, x in enumerate(samples)], "vec_id long, samples array<double>, class_id string")
    members, matches = chroma.align(rows, "vec_id", "samples", chroma.SHORT, query_step=5)
    got = {(m["query_class"], m["match_class"]): m for m in matches.collect()}
    of = dict(members.collect())
    assert all(of[350 + k] == k for k in range(20))
    prints = [chroma.fingerprint(x, chroma.SHORT)[0].view(np.int32) for x in samples[:350]]
    want = {}
    for i in range(0, 350, 5):
        for j in range(350):
            if i != j and (e := min(chroma.bit_error(prints[i], prints[j], k) for k in range(-3, 4))) <= chroma.BIT_ERROR:
                want[i, j] = e
    own = {k: m for k, m in got.items() if k[0] % 5 == 0}
    assert set(own) <= set(want) and len(own) >= 0.95 * len(want) and len(want) > 60
    assert all(m["bit_error"] == chroma.bit_error(prints[k[0]], prints[k[1]], m["offset"]) >= want[k] for k, m in own.items())
    assert sum((k, k + 150) in own for k in range(0, 150, 5)) >= 0.9 * 30
    assert chroma.align(rows.where("false"), "vec_id", "samples", chroma.SHORT)[1].count() == 0
    twice = rows.union(rows.where("vec_id < 10"))
    again = chroma.align(twice, "vec_id", "samples", chroma.SHORT, query_step=5)
    assert again[0].count() == 380 and sorted(again[1].collect()) == sorted(matches.collect())


# all -------------------------------------------------------------------------------------------------------------


def test_queries_have_the_contracts_columns(spark, folder):
    want = {
        "op2_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op3_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
        "op5_toxicity": "doc_id held_out score predicted",
        "op7_minhash_near_dedup": "doc_id n_shingles component_id kept",
        "op8_token_store": "doc_id start n_tokens ids_crc32",
        "op9_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op10_histogram_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, folder).columns == columns.split()
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline") == list(range(1, 11))


def test_chat_query_equals_sql(spark, folder):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    r = c.execute(queries.ORACLE["op2_chat_format"])
    want = {x[0]: x for x in r.fetchall()}
    for x in queries.op2_chat_format(spark, folder).collect():
        assert tuple(x) == want[x["conv_id"]]
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
