"""URL filters, fingerprints, decontamination, tokens: against brute force and on odd inputs."""

from __future__ import annotations

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, fingerprint, token_count, url_filter

ODD = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, None, None, None) for i, t in enumerate(texts)], ODD)


# --- URL filters ---------------------------------------------------------------


def glob_regex(glob: str) -> str:
    out = ""
    for part in re.findall(r"\*\*|\*|\?|[^*?]+", glob):
        out += {"**": r"[\s\S]*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part)
    return out


def test_globs_against_regex():
    rnd = random.Random(3)
    globs = ["".join(rnd.choice(["a", "b", "/", ".", "*", "**", "?", "é"]) for _ in range(rnd.randint(0, 9))) for _ in range(150)]
    texts = ["".join(rnd.choice("ab/.é漢") for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    got = url_filter.GlobAutomaton(globs).matches([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert got[i].tolist() == [re.fullmatch(glob_regex(g), t) is not None for g in globs]


def test_long_urls_take_the_same_way():
    auto = url_filter.GlobAutomaton(["*.com/a**z", "**b*"])
    texts = [b".x.com/a" + b"q" * n + b"z" for n in (1, url_filter.LONG_URL - 9, url_filter.LONG_URL, 50_000)]
    assert auto.matches(texts).tolist() == [[True, False]] * 4


def test_url_query_on_odd_rows(spark):
    urls = ["http://A.Example.COM/en/7?x", "x://com/en/", "http://example.com/en/6#a", None, "no scheme", "://", "http://xcom/en/1", "http://example.net/de/88", "http://a.net/de/", "http://spam-farm.x/", "http://a.org/es/\n", "http://h?/en/"]
    df = spark.createDataFrame([(i, u, None, 1, "x") for i, u in enumerate(urls + urls[:1])], "page_id long, url string, html string, host int, verdict string")
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, url_filter.RULES).collect()}
    assert rows[0] == rows[len(urls)] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert rows[1] == ("com", "/en/", "com/en/", "block")
    assert rows[2][2:] == ("com/en/", "block")
    assert rows[3] == rows[4] == ("", "", None, "allow")
    assert rows[5] == ("", "", None, "allow")
    assert rows[6][2:] == (None, "allow")
    assert rows[7][2:] == ("example.net/de/8", "block") and rows[8][2:] == ("net/de/", "allow")
    assert rows[9][2:] == (None, "block")
    assert rows[10][2:] == ("org/es/", "block")
    assert rows[11][:2] == ("h", "")
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES).count() == 0


# --- fingerprints ------------------------------------------------------------------


def test_chunks_against_plain_loop():
    rnd = random.Random(5)
    texts = [bytes(rnd.randrange(97, 101) for _ in range(rnd.choice([0, 1, 15, 16, 17, 200, 3000]))) for _ in range(60)]
    for t, ends in zip(texts, fingerprint.chunk_ends(texts), strict=True):
        base = ends[-1] - len(t) if ends else 0
        cuts, low = [], 0
        while low < len(t):
            at = len(t)
            if len(t) - low > fingerprint.LEAST:
                for i in range(low + fingerprint.LEAST - 1, len(t)):
                    h = sum(int(fingerprint.GEAR[t[i - k]]) << k for k in range(fingerprint.WINDOW)) & 0xFFFFFFFF
                    n = i + 1 - low
                    bits = fingerprint.STRICT_BITS if n <= fingerprint.NORMAL else fingerprint.LOOSE_BITS
                    if h >> (32 - bits) == 0 or n == fingerprint.MOST:
                        at = i + 1
                        break
            cuts.append(at)
            low = at
        assert [e - base for e in ends] == cuts


def test_edits_resynchronise():
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(20_000)).encode()
    a, b, c = fingerprint.fingerprints([text, text[:7000] + b"XYZ" + text[7000:], text[::-1]])
    assert fingerprint.containment(a, b) > 0.97 and fingerprint.containment(a, c) < 0.05
    assert fingerprint.parse(fingerprint.as_text(a)) == a


def test_fingerprint_query(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aé漢b \n") for _ in range(rnd.choice([0, 1, 2, 5, 400]))) for _ in range(80)] + [None, "", "same", "same"]
    df = docs(spark, texts).withColumn("fingerprint", F.lit(1)).withColumn("_range", F.lit(2)).repartition(5)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints_with_edits(df).collect()}
    full = [t or "" for t in texts]
    assert len(got) == len(texts)
    for i, t in enumerate(full):
        after = full[i - 1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, ed, nx = fingerprint.fingerprints([t.encode(), edited.encode(), after.encode()])
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), sha256(edited.encode()).hexdigest())
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (fingerprint.as_text(own), fingerprint.as_text(ed))
        assert (got[i]["near_edited"], got[i]["near_next"]) == (fingerprint.containment(own, ed), fingerprint.containment(own, nx))
    assert fingerprint.fingerprints_with_edits(df.limit(0)).count() == 0
    one = fingerprint.fingerprints_with_edits(docs(spark, ["abcd"])).first()
    assert one["edited_sha256"] == sha256(b"abab").hexdigest()
    same = fingerprint.fingerprints_with_edits(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (None, None)], "doc_id long, text string"))
    assert same.count() == 4
    assert fingerprint.fingerprint_documents(docs(spark, ["x", None])).count() == 2


# --- decontamination ----------------------------------------------------------------


def brute_hits(text, items, window):
    ws = decontaminate.words(text)
    hit, ids = set(), set()
    for key, item in items:
        iw = decontaminate.words(item)
        m = min(window, len(iw))
        if not m:
            continue
        wins = {tuple(iw[k : k + m]) for k in range(len(iw) - m + 1)}
        for k in range(len(ws) - m + 1):
            if tuple(ws[k : k + m]) in wins:
                hit |= set(range(k, k + m))
                if key is not None:
                    ids.add(str(key))
    return len(ws), len(hit), sorted(ids)


@pytest.mark.parametrize("block", [7, 30, 1000])
def test_scan_against_brute_force(spark, block):
    rnd = random.Random(11)
    make = lambda n: " ".join(rnd.choice(["a", "B", "c", "é"]) for _ in range(n))
    items = [(i, make(rnd.choice([0, 1, 2, 3, 4, 5, 9, 14]))) for i in range(12)] + [(3, make(6)), (None, make(8)), (77, None), (78, "")]
    texts = [make(rnd.choice([0, 1, 3, 12, 60])).replace("a", "a.-") for _ in range(60)] + [None, "", items[5][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan_documents(docs(spark, texts).withColumn("extra", F.array(F.lit(1))), bench, window=5, block_words=block).collect()
    for r in got:
        spans = sum(z - a for a, z in zip(r["hit_from"], r["hit_to"], strict=True))
        assert (r["n_words"], spans, r["items"]) == brute_hits(texts[r["doc_id"]], items, 5), texts[r["doc_id"]]


@pytest.mark.parametrize("block", [12, 1000])
def test_cut_texts_are_clean(spark, block):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(14))) for i in range(6)]
    clean = [" ".join(word() for _ in range(40)) + " ünd\n" for _ in range(5)]
    dirty = [clean[0] + " " + items[0][1].upper().replace(" ", ", ") + " " + clean[1], items[1][1], items[2][1] + " x", clean[2] + items[3][1] + " " + " ".join(items[4][1].split()[:10])]
    df = docs(spark, [*clean, *dirty, None, ""]).withColumn("_words", F.lit(5)).withColumn("_row", F.lit("x"))
    out = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert [got.get(i) for i in range(5)] == clean
    assert got[9] is None and got[10] == ""
    assert 6 not in got and 7 not in got
    assert all(brute_hits(t, items, 10)[1] == 0 for t in got.values())
    assert got[5].startswith(clean[0]) and got[5].endswith(clean[1])
    assert decontaminate.decontaminate(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.decontaminate(df, spark.createDataFrame([], "item_id long, text string")).count() == df.count()


@pytest.mark.parametrize(("block", "group"), [(3, 1), (3, 2), (200_000, 2)])
def test_decontaminate_cuts_to_the_end(spark, block, group, monkeypatch):
    """Passages of two items inside one another: each cut joins the words around it, whatever the blocks and their groups."""
    monkeypatch.setattr(decontaminate, "GROUP", group)
    items, filler, nested = [(0, "aa bb cc"), (1, "dd ee ff")], [f"word{i}" for i in range(60)], "aa bb cc"
    for k in range(1, 7):
        first, last = items[k % 2][1].rsplit(" ", 1)
        nested = f"{first} {nested} {last}"
    df = spark.createDataFrame([(1, " ".join([*filler[:30], nested, *filler[30:]])), (2, "aa bb"), (3, nested)], "doc_id long, text string")
    out = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert sorted(got) == [1, 2] and got[1].split() == filler and got[2] == "aa bb"


# --- byte-level BPE -----------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    tiktoken, p = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    c = bpe.codec(*bpe.default_vocabulary())
    return c, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def test_bpe_against_library(encoding, sf):
    import pyarrow.parquet as pq

    c, enc = encoding
    rnd = random.Random(1)
    made = ["".join(rnd.choice("aàb'st \n\t\x1c\x85　\xa0re1²٣_!?\U0001f600é漢字l\x00") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    for t in [*made, *pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()]:
        ids = c.encode(t)
        assert ids == enc.encode_ordinary(t)
        assert c.decode_bytes(ids) == t.encode()


def test_long_pretokens(encoding):
    c, enc = encoding
    rnd = random.Random(2)
    for t in ("a" * 5000, "ab" * 3000, "".join(rnd.choice("abcde") for _ in range(20_000)), "x" * bpe.SHORT, "x" * (bpe.SHORT + 1)):
        assert c.encode(t) == enc.encode_ordinary(t)
        raw = t.encode()[: bpe.SHORT]
        assert c._short(raw) == c._long(raw)


def test_bpe_frames(spark, encoding):
    _, enc = encoding
    texts = ["hello world", None, "", "naïve 漢字", "hello world"]
    df = docs(spark, texts).withColumn("n_tokens", F.lit("x"))
    rows = bpe.decode_documents(bpe.encode_documents(df)).collect()
    assert [bytes(r["decoded"]).decode() for r in rows] == [t or "" for t in texts]
    for r in bpe.digests(df, *bpe.default_vocabulary()).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((texts[r["doc_id"]] or "").encode()).hexdigest())
    assert bpe.digests(df.limit(0), *bpe.default_vocabulary()).count() == 0


# --- token counts --------------------------------------------------------------------


def greedy(word, pieces):
    at, n = 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if (token_count.MARK if at == 0 else "") + word[at:end] in pieces:
                break
        else:
            return -1
        at, n = end, n + 1
    return n


def test_longest_match_against_greedy():
    rnd = random.Random(9)
    for _ in range(60):
        pieces = {rnd.choice(["", token_count.MARK]) + "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 25))}
        c = token_count.Counter(pieces)
        for _ in range(80):
            w = "".join(rnd.choice("abcd" if rnd.random() < 0.1 else "abc") for _ in range(rnd.randint(1, 14)))
            assert c[w] == greedy(w, pieces), (w, pieces)


def test_token_count_frame(spark):
    pytest.importorskip("public_tokenizers")
    pieces = set(token_count.load_pieces(token_count.default_vocabulary()))
    texts = ["hello the world", None, "", " \n", "x" * 5000, "\x01 the", "hello the world"]
    for r in token_count.count_tokens(docs(spark, texts).withColumn("n_words", F.lit(1))).collect():
        counts = [greedy(w, pieces) if len(w) < 100 else None for w in (texts[r["doc_id"]] or "").split()]
        assert r["n_words"] == len(counts)
        if None not in counts:
            assert r["n_tokens"] == sum(max(c, 1) if c >= 0 else 1 for c in counts) and r["n_unknown"] == counts.count(-1)


def test_columns_of_the_same_names_are_replaced(spark):
    from tidemark.llm import bpe, lang_id

    df = spark.createDataFrame([(1, "one two", "x", 3)], "doc_id long, text string, score string, items int")
    model = lang_id.Model(["a"], {lang_id.MARK + "one": (0.5,)})
    got = lang_id.identify(df.withColumn("lang_pred", F.lit(1)), model)
    assert got.columns == ["doc_id", "text", "items", "lang_pred", "score"] and got.first()["lang_pred"] == "a"
    out = decontaminate.scan_documents(df.withColumn("n_words", F.lit("x")), spark.createDataFrame([(1, "two")], "item_id long, text string"))
    assert out.first()["items"] == ["1"] and out.first()["n_words"] == 2 and out.columns.count("items") == 1
    ids = bpe.encode_documents(df.withColumn("ids", F.lit(0)).withColumn("ok", F.lit(0)), check="ok").first()
    assert ids["ok"] is True and len(ids["ids"]) > 0


def test_null_ids_spread_over_ranges(spark):
    from tidemark.llm.ordering import dealt_in_order

    rows = [(None, f"t{i}") for i in range(200)] + [(i, "x") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dealt_in_order(df, "doc_id", [F.xxhash64("text")])
    assert got.filter("doc_id IS NULL AND NOT _carried").select("_range").distinct().count() > 4
    assert got.filter("NOT _carried").count() == 220
    order = [r["text"] for r in df.filter("doc_id IS NULL").orderBy(F.xxhash64("text")).collect()]
    by_range = [r["text"] for r in got.filter("doc_id IS NULL AND NOT _carried").orderBy("_range", F.xxhash64("text")).collect()]
    assert by_range == order


def test_rules_from_a_file(spark, tmp_path):
    from tidemark.llm import url_filter

    (tmp_path / "rules").write_text("# junk\nblock *.junk.**\n\nallow  *.junk.org/ok**\n")
    rules = url_filter.read_rules(spark, str(tmp_path / "rules"))
    pages = spark.createDataFrame([(1, "http://a.junk.org/x"), (2, "http://a.junk.org/ok/1"), (3, "http://b.org/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, [], rules).collect()} == {1: "block", 2: "allow", 3: "allow"}
    (tmp_path / "bad").write_text("deny x\n")
    with pytest.raises(ValueError):
        url_filter.read_rules(spark, str(tmp_path / "bad"))
