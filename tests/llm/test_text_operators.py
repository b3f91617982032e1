"""Text operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import bytebpe, minhash, mixing, phrases, pii, quality, repeats, suffixes, tokenfile, vectext

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(n))


def corpus():
    a, b, c = prose(1, 300), prose(2, 200), prose(3, 120)
    near = a.split()
    near[150] = "CHANGED"
    rows = [(5, a), (3, a), (9, " ".join(near)), (1, b + "\n" + c), (2, c + " tail"), (7, "x " + c), (11, "ab " * 300), (12, "ab " * 300), (13, "a b"), (14, "A b"), (15, ""), (16, None), (17, " \t\n"), (18, prose(8, 30_000)), (19, "Ω" * 150 + c)]
    return [*rows, (5, a), (None, a), (None, None)]


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def check_phrases(docs, rows, size=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[j : j + size]) for w in words for j in range(len(w) - size + 1))
    want = Counter()
    for (i, _), w in zip(rows, words):
        gone = {k for j in range(len(w) - size + 1) if seen[tuple(w[j : j + size])] > 1 for k in range(j, j + size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = phrases.deduplicate(docs(rows, extra=True)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def check_suffixes(docs, rows, size=100, run=suffixes.deduplicate):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - size + 1):
            if i is not None:
                first[b[j : j + size]] = min(first.get(b[j : j + size], (i, j)), (i, j))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - size + 1):
            if i is not None and first[b[j : j + size]] < (i, j):
                gone[j : j + size] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = run(docs(rows, extra=True), threshold=size).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def one_id_many_texts():
    """Ids, null too, that come with several texts; copies elsewhere of one of them only."""
    a, b, c = prose(21, 80), prose(22, 80), prose(23, 80)
    return [(None, a), (None, b), (2, a), (4, c), (4, b[:200] + c), (4, prose(24, 90)), (4, c), (6, b), (7, prose(25, 40) + " " + c), (8, prose(26, 90))]


@pytest.mark.parametrize("rows", [corpus, one_id_many_texts])
def test_phrases_equal_brute_force(docs, rows):
    check_phrases(docs, rows())


@pytest.mark.parametrize("rows", [corpus, one_id_many_texts])
def test_suffixes_equal_brute_force(docs, rows):
    check_suffixes(docs, rows())


@pytest.mark.parametrize("size", (100, 37, 5))
def test_prefix_doubling_equals_brute_force(docs, size):
    rows = [(i, t if t is None else t[:900]) for i, t in corpus() + one_id_many_texts()]
    check_suffixes(docs, rows, size, suffixes.by_doubling)
    assert suffixes.by_doubling(docs(rows).where("false")).count() == 0


@pytest.mark.parametrize("earlier", (True, False))
def test_phrase_in_many_surroundings(earlier, monkeypatch):
    """Runs of a hot name, dealt by stretch or not, leave the same windows to be removed after both rounds."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    n = 600
    doc, place = np.arange(n) // 3, rng.integers(0, 9, n) << 16
    sub = np.zeros(n, np.int64)
    name = rng.choice(np.array([5, 7, 11, 1 << 40], np.uint64), n)
    whole = name * np.uint64(1000) + rng.integers(0, 120, n).astype(np.uint64)
    more = np.zeros(n, np.uint32)

    def outcome(many):
        monkeypatch.setattr(repeats, "MANY", many)
        seen, got = repeats.Seen(), []
        for a in range(0, n, 100):
            s = slice(a, a + 100)
            got.append(repeats.blocks(doc[s], sub[s], place[s], name[s], whole[s], more[s], 4, earlier, seen))
        table, removed, edge = pa.Table.from_batches(got), set(), set()
        for b in range(4):
            part = table.filter(pa.compute.equal(table["bucket"], b))
            if part.num_rows:
                v = repeats.resolve(earlier, True)(part).to_pydict()
                for d, p, k in zip(v["doc_id"], v["place"], v["kind"]):
                    (removed if k & repeats.REMOVED else edge).add((d, p))
                    if k & repeats.EDGE:
                        edge.add((d, p))
        return removed, edge

    plain, edges = outcome(10**6)
    assert {(int(d), int(p)) for d, p in zip(doc, place)} >= plain | edges
    for many in (2, 10, 20):
        removed, edge = outcome(many)
        # What is not decided by stretch goes on to be compared window by window.
        assert removed <= plain and plain - removed <= edge and edges <= edge | removed
        assert len(edge) < n


def test_many_ids_with_several_texts(docs, monkeypatch):
    monkeypatch.setattr(repeats, "FEW_IDS", 0)  # they are joined, not broadcast
    check_phrases(docs, one_id_many_texts())
    check_suffixes(docs, one_id_many_texts())


def test_long_text_in_pieces(docs, monkeypatch):
    """A row longer than a piece and a chunk."""
    long = prose(31, 700_000)
    assert len(long.encode()) > repeats.PIECE
    inner = " ".join(long.split()[500_000:500_120])
    rows = [(1, long), (2, inner), (3, prose(32, 100)), (4, inner + " x " + inner)]
    got = {r.doc_id: (r.n_removed, r.n_words) for r in phrases.deduplicate(docs(rows)).collect()}
    assert got == {1: (120, 700_000), 2: (120, 120), 3: (0, 100), 4: (240, 241)}
    got = {r.doc_id: r.n_removed for r in suffixes.deduplicate(docs(rows)).collect()}
    n = len(inner.encode())
    assert got[1] == got[3] == 0 and got[2] == n and 2 * n <= got[4] <= 2 * n + 2


def test_phrases_come_from_the_automaton(docs, monkeypatch):
    """Nothing is removed where the automata hold no phrase."""
    from pyspark.sql import DataFrame

    written = phrases.store.written

    def none_confirmed(df: DataFrame, name: str, **more):
        return written(df.where("false") if name == "phrases-confirmed" else df, name, **more)

    monkeypatch.setattr(phrases.store, "written", none_confirmed)
    got = phrases.deduplicate(docs(corpus())).collect()
    assert len(got) == len(corpus()) and not any(r.n_removed for r in got)


def test_automaton_locates_every_occurrence():
    import pyarrow as pa

    t = next(vectext.chunks(pa.array(["a b c a b", "xa b  c a", "b c a b c"])))
    w = vectext.Words(t)
    hit = phrases.locate(phrases.compiled([b" a b ", b" b c a "]), *phrases.joined(t, w))
    assert np.flatnonzero(hit).tolist() == [0, 1, 3, 6, 9, 11]
    assert not phrases.locate(phrases.compiled([]), *phrases.joined(t, w)).any()


@pytest.mark.parametrize("earlier", (True, False))
def test_blocks_and_verdicts_equal_brute_force(earlier):
    """Many chunks of few stretches: what chunks and tasks combine is what no combining gives."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    doc, sub, place, whole = rng.integers(0, 60, 900), rng.integers(0, 2, 900), rng.integers(0, 5, 900), rng.integers(0, 90, 900).astype(np.uint64) ** np.uint64(3)
    more = (whole % np.uint64(7)).astype(np.uint32)
    seen, got = repeats.Seen(), []
    for a in range(0, 900, 30):
        s = slice(a, a + 30)
        name = whole[s]
        got.append(repeats.blocks(doc[s], sub[s], place[s], name, name, more[s], 4, earlier, seen))
    table, out = pa.Table.from_batches(got), set()
    for b in range(4):
        part = table.filter(pa.compute.equal(table["bucket"], b))
        if part.num_rows:
            v = repeats.resolve(earlier, False)(part)
            out |= {(d, x, p) for d, x, p, k in zip(*(v[c].to_pylist() for c in v.column_names)) if k & repeats.REMOVED}
    want = set()
    for i in range(900):
        same = np.flatnonzero(whole == whole[i])
        other = any((doc[j], place[j]) < (doc[i], place[i]) for j in same) if earlier else len(same) > 1
        if other:
            want.add((int(doc[i]), int(sub[i]), int(place[i])))
    assert out == want


def thue_morse_words():
    """Two words of 1,024 bytes that any polynomial hash modulo 2**64 takes for one."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_patterned_words_have_their_own_hashes(docs, spark, tmp_path):
    import pyarrow as pa

    a, b = thue_morse_words()
    for k in (1, 2, 40):  # long strings, too
        t = next(vectext.chunks(pa.array([f"{a * k} {b * k}"])))
        for lane in vectext.Words(t).lanes(t):
            assert lane[0] != lane[1]
    rows = [(1, f"{a} x y z"), (2, f"{b} x y z")]
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows)).collect()} == {1: 1, 2: 2}
    rows = [(1, a + a), (2, b + b), (3, f"{a + a} {b + b}")]
    tokenizer = tokenfile.cache(P.path("word_bpe_49k.json")).tokenizer
    got = {r.doc_id: list(r.ids) for r in tokenfile.encoded(docs(rows), P.path("word_bpe_49k.json"), end_id=2).collect()}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}
    check_suffixes(docs, [(1, a), (2, b), (3, prose(5, 60) + a[300:700])])


def test_near_duplicates_equal_brute_force(docs):
    rows = corpus()
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    head = {i: i for i in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for a in head:
            for b in head:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * len(sets[a] | sets[b]) and head[a] < head[b]:
                    head[b] = head[a]
                    changed = True
    got = minhash.near_duplicates(docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), head[r.doc_id], head[r.doc_id] == r.doc_id), r
    kept = minhash.deduplicate(docs(rows), k=4)
    assert {r.doc_id for r in kept.collect()} == {i for i in head if head[i] == i} | {None}
    assert kept.columns == docs(rows).columns


def encoder():
    vocab = bytebpe.vocabulary(RANKS)
    return vocab, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="  \n\t'srtevmlda19é中!.  😀", max_size=60), min_size=1, max_size=8))
def test_pretokens_and_merges_equal_library(texts):
    import pyarrow as pa

    from tallyloom.llm import vectext

    vocab, enc = encoder()
    got = []
    for t in vectext.chunks(pa.array(texts)):
        ids, offsets, limits, decoded = bytebpe.checked(t, vocab)
        assert np.array_equal(decoded, t.data)
        got += [ids[a:b].tolist() for a, b in zip(limits[:-1], limits[1:])]
        for i in range(t.rows):
            lengths = vocab.length[ids[limits[i] : limits[i + 1]]]
            assert offsets[limits[i] : limits[i + 1]].tolist() == (np.cumsum(lengths) - lengths).tolist()
    assert got == [enc.encode_ordinary(x) for x in texts]


def test_bpe_rows(docs):
    rows = [(1, "Hello  world's\n"), (2, None), (2, ""), (None, "x"), (4, "z" * 20_000), (4, "<|endoftext|>")]
    _, enc = encoder()
    got = bytebpe.digests(docs(rows, extra=True), RANKS).collect()
    want = Counter((i, len(e := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter(tuple(r) for r in got) == want
    encoded = bytebpe.encode(docs(rows), RANKS)
    assert all(r.round_trip for r in encoded.collect())
    assert sorted(bytes(r.data) for r in bytebpe.decode(encoded, RANKS).collect()) == sorted((t or "").encode() for _, t in rows)


def brute_spans(t):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.+- ()@ab%é\n", max_size=60))
def test_base_spans_equal_patterns(t):
    assert [s for s in pii.spans(t) if s[2] in pii.BASE] == brute_spans(t)


def test_pii_rows_and_masks(docs):
    t = "é a.b@c.de, 1.2.3.4 and 4111 1111 1111 1111; +1 (212) 555-0100 IBAN DE89 3704 0044 0532 0130 00 http://u:p@h.com"
    rows = [(1, t), (1, t), (2, None), (3, ""), (None, "a@b.cd"), (4, "clean text 12.5 and 3")]
    got = by_id(pii.detect(docs(rows, extra=True)))
    assert {s[2] for s in pii.spans(t)} == set(pii.KINDS)
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got[1]] == [(2, 1, 1, 1)] * 2 or got[1][0].n_email == len([s for s in brute_spans(t) if s[2] == "email"])
    base = ",".join(f"{k}:{a}:{b}" for a, b, k in brute_spans(t))
    assert got[1][0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[2][0].spans == got[3][0].spans == got[4][0].spans == ""
    masked = {r.doc_id: r for r in pii.mask(docs(rows), chars_col="n_chars").collect()}
    assert masked[4].text == "clean text 12.5 and 3" and masked[2].text is None and masked[2].n_chars is None
    assert "@c.de" not in masked[1].text and "4111" not in masked[1].text and masked[1].n_chars == len(masked[1].text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("x DE89370400440532013000 y", ["DE89370400440532013000"]),
        ("x DE89 3704 0044 0532 0130 00, y", ["DE89 3704 0044 0532 0130 00"]),
        ("DE89370400440532013001", []),  # check digits
        ("XDE89370400440532013000", []),  # no word begins there
        ("Account no. 1234-5678-90.", ["1234-5678-90"]),
        ("SSN: 123-45-6789", ["123-45-6789"]),
        ("passport number 123456789 and 987654321", ["123456789"]),
        ("accounting 12345678", []),
        ("account of the year 2024", []),
        ("acct 123456x", []),
        ("iban GB82 WEST 1234 5698 7654 32 iban GB82WEST12345698765432", ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"]),
    ],
)
def test_accounts(text, want):
    assert [text[a:b] for a, b, k in pii.spans(text) if k == "account"] == want


def test_long_and_empty_for_pii(docs):
    long = "a" * 50_000 + " x@y.zz " + "1 " * 60_000 + "+1 212 555 0100"
    got = {r.doc_id: r for r in pii.detect(docs([(1, long), (2, "")])).collect()}
    assert (got[1].n_email, got[1].n_phone) == (1, 1)
    assert pii.mask(docs([(1, "x")]).where("false"), chars_col="n_chars").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="  \n\tAbé'19Σİ中!.😀\u00a0e\u0301<|", max_size=40), min_size=1, max_size=6))
def test_token_ids_equal_library(texts):
    import pyarrow as pa

    cache = tokenfile.cache(P.path("word_bpe_49k.json"))
    got = []
    for t in vectext.chunks(pa.array(texts)):
        ids, limits = cache.encode(t)
        got += [ids[a:b].tolist() for a, b in zip(limits[:-1], limits[1:])]
    assert got == [cache.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_of_one_hash_are_encoded_without_the_cache(monkeypatch):
    import pyarrow as pa

    lanes = vectext.Words.lanes
    monkeypatch.setattr(vectext.Words, "lanes", lambda w, t: [np.full_like(x, 5) if k == 0 else x for k, x in enumerate(lanes(w, t))])
    cache = tokenfile.WordCache(P.path("word_bpe_49k.json"))
    ids, limits = cache.encode(next(vectext.chunks(pa.array(["hello world", "", "world"]))))
    assert [ids[a:b].tolist() for a, b in zip(limits[:-1], limits[1:])] == [cache.tokenizer.encode(x, add_special_tokens=False).ids for x in ("hello world", "", "world")]


@pytest.mark.parametrize("dictionary", (True, False))
def test_token_file_footers(docs, tmp_path, dictionary):
    """Row groups, pages, page indexes and encodings are those asked for."""
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "ids")
    rows = [(i, prose(i, 300)) for i in range(400)]
    tokenfile.write(tokenfile.encoded(docs(rows).coalesce(1), P.path("word_bpe_49k.json"), end_id=2), path, row_group_bytes=64 << 10, page_bytes=8 << 10, page_rows=50, dictionary=dictionary)
    groups, encodings, index = 0, set(), True
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                index &= column.has_offset_index and column.has_column_index
                assert column.compression == "ZSTD"
                if column.path_in_schema.startswith("ids"):
                    encodings |= set(column.encodings)
    assert groups > 2 and index
    assert ("RLE_DICTIONARY" in encodings or "PLAIN_DICTIONARY" in encodings) == dictionary
    assert dictionary or "DELTA_BINARY_PACKED" in encodings


def test_empty_tables_of_files_and_classifier(docs, spark, tmp_path):
    none = docs([(1, "x")]).where("false")
    tokenfile.write(tokenfile.encoded(none, P.path("word_bpe_49k.json"), end_id=2), str(tmp_path / "e"))
    assert tokenfile.digests(spark, str(tmp_path / "e")).count() == 0
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    machine = quality.train(none, labels)
    assert quality.score(none, machine).count() == 0 and quality.keep(none, machine).count() == 0
    assert minhash.deduplicate(none).count() == 0


def test_steps_are_chosen_from_training_rows_only():
    """The number of mini-batches depends on the rows given, and on nothing else."""
    rng = np.random.default_rng(3)
    rows, n = 200, 8
    row = np.repeat(np.arange(rows), n)
    y = (np.arange(rows) % 2).astype(float)
    feat = rng.integers(0, 40, rows * n) + np.repeat(np.where(y > 0, 0, 30), n)
    x = np.ones(rows * n)
    a, b = quality.fit(row, feat, x, y), quality.fit(row, feat, x, y)
    assert np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)
    assert ((a.margins(row, feat, x, rows) > 0) == (y > 0)).mean() > 0.9


def test_token_files(docs, spark, tmp_path):
    rows = [(4, "Hello world!"), (2, None), (9, "it's  ÉTÉ 😀 <|endoftext|>"), (None, "first"), (4, "Hello world!"), (7, prose(4, 5000)), (8, "")]
    path = str(tmp_path / "ids")
    tokenfile.write(tokenfile.encoded(docs(rows, extra=True), P.path("word_bpe_49k.json"), end_id=2), path)
    tokenizer = tokenfile.cache(P.path("word_bpe_49k.json")).tokenizer
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    order = sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want, at = Counter(), 0
    for i in order:
        want[(i, at, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))] += 1
        at += len(ids[i])
    assert Counter(tuple(r)[:4] for r in tokenfile.digests(spark, path).collect()) == want
    some = tokenfile.read(spark, path, 7, 8, ["doc_id", "n_tokens"])
    assert {r.doc_id: r.n_tokens for r in some.collect()} == {7: len(ids[7]), 8: 1}
    tokenfile.write(tokenfile.encoded(docs(rows[:1]), P.path("word_bpe_49k.json"), end_id=2), path + "2", dictionary=False)
    assert tokenfile.read(spark, path + "2").first().ids == ids[4]


def test_mix_meets_targets(docs, spark):
    rows = [(i, prose(i, 1 + i % 40)) for i in range(400)] + [(7, None), (None, "a b c"), (8, "")]
    df = docs(rows).withColumn("source", F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("source")))
    for words in (50, 200_000):
        got = mixing.mix(df, block_words=words).collect()
        assert len(got) == len(rows)
        again = Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(df.repartition(5), block_words=words).collect())
        assert again == Counter((r.doc_id, r.size, r.taken) for r in got)
        for source in {r.source for r in got}:
            own = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 1
            assert own[0].source_size == sum(r.size for r in own)
        assert all(r.taken <= 3 * r.size and r.taken == sum(d.words for d in r.draws) for r in got)
    out = mixing.materialise(df, mixing.mix(df, whole=True))
    assert out.columns == df.columns and out.count() > 0
    assert mixing.mix(df.where("false")).count() == 0


def by_hand(spark, rows, weights=(1, 2, 3), shards=16, block_words=50, seed=11):
    """(id, size, taken, draws) of each row by plain loops over the stated plan; only Spark's hash is borrowed."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = df.select("*", mixing.row_hash(seed, "doc_id", "text", "source").alias("h")).withColumn("b", F.xxhash64(F.lit(seed + 1), "h")).collect()
    sources = sorted({r.source for r in hashed}, key=lambda x: (x is None, x or ""))
    own = {s: [r for r in hashed if r.source == s] for s in sources}
    size = lambda r: len(WORD.findall(r.text or ""))
    words = [sum(map(size, own[s])) for s in sources]
    goal, out, orders = mixing.targets(words, weights), {}, []
    for i, s in enumerate(sources):
        n = max(1, min(len(own[s]), -(-words[i] // block_words)))
        epochs = int(goal[i] // words[i]) if words[i] else 0
        rest = int(round(goal[i] - epochs * words[i]))
        rng = np.random.default_rng([seed, i])
        mul = next(x for x in map(int, rng.integers(1, max(2, n), 1000)) if np.gcd(x, n) == 1) if n > 1 else 1
        add = int(rng.integers(0, n))
        blocks = {}
        for r in own[s]:
            blocks.setdefault((r.b % n * mul + add) % n, []).append(r)
        left = rest
        for k in range(n):
            for r in sorted(blocks.get(k, []), key=lambda r: (r.h, r.doc_id is not None, r.doc_id or 0, size(r))):
                extra = min(size(r), max(0, left))
                left -= extra
                out.setdefault((r.doc_id, r.text, r.source), []).append((size(r), epochs * size(r) + extra, [(e, k, size(r) if e < epochs else extra) for e in range(epochs + (extra > 0))]))
        orders.append((s, n, epochs * n + int(np.ceil(n * (goal[i] - epochs * words[i]) / words[i])) if words[i] else 0))
    return out, orders


@pytest.mark.parametrize("group", (2, 4096))
def test_mix_equals_loops(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP_BLOCKS", group)
    rows = [(i, prose(i, 1 + i % 23), None if i % 7 == 0 else f"s{i % 4 % 3}") for i in range(150)] + [(5, None, "s0"), (None, "a b c", "s1"), (8, "", None)] + [(900, "q " * 30, "s2")] * 5
    want, orders = by_hand(spark, rows)
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=50).collect()
    texts = Counter((r.doc_id, r.source, r.size, r.taken) for r in got)
    assert texts == Counter((k[0], k[2], n, taken) for k, v in want.items() for n, taken, _ in v)
    # Shards: a source's draws, epoch by epoch in block order, fill its quotas of the tree one after another.
    ends = {s: np.cumsum(q) for (s, _, _), q in zip(orders, mixing.split_tree([c for _, _, c in orders], 16))}
    blocks = {s: n for s, n, _ in orders}
    shard = lambda s, e, k: min(15, int((ends[s] <= e * blocks[s] + k).sum()))
    mine = Counter((k[0], k[2], e, shard(k[2], e, b), w) for k, v in want.items() for _, _, draws in v for e, b, w in draws)
    assert Counter((r.doc_id, r.source, d.epoch, d.shard, d.words) for r in got for d in r.draws) == mine


def test_materialised_rows_are_the_draws(docs):
    rows = [(i, prose(i, 1 + i % 40)) for i in range(60)] + [(7, "same words here")] * 5 + [(None, "a b c"), (8, ""), (9, None)]
    df = docs(rows)
    for c in ("_id", "_h", "_d", "h", "nth", "draw", "row", "shard", "epoch"):
        df = df.withColumn(c, F.col("lang"))
    for seed in (11, 12, 13):
        df = df.withColumn("source", F.when(F.col("doc_id") == 7, "s9").otherwise(F.col("source")))
        mixed = mixing.mix(df, whole=True, seed=seed)
        want = Counter()
        for r in mixed.collect():
            want[(r.doc_id, r.source, r.size)] += len([d for d in r.draws if r.taken])
        out = mixing.materialise(df, mixed, seed=seed)
        assert out.columns == df.columns
        assert Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in out.collect()) == +want
    none = df.where("false")
    assert mixing.materialise(none, mixing.mix(none)).count() == 0


def test_mix_targets_and_tree():
    assert mixing.targets([100, 100, 100]) == [50.0, 100.0, 150.0]
    t = mixing.targets([10, 10, 1000])
    assert t == [30.0, 30.0, 960.0] and sum(t) == 1020
    assert mixing.targets([0, 0]) == [0.0, 0.0]
    split = mixing.split_tree([7, 0, 25], 5)
    assert split.sum(1).tolist() == [7, 0, 25] and max(split.sum(0)) - min(split.sum(0)) <= 2


def test_quality_learns_and_keeps_clean(docs, spark):
    good = [(i, prose(i, 120)) for i in range(120)]
    bad = [(1000 + i, ("BUY!! NOW!! " * 60) if i % 2 else "spam spam spam " * 80) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(5, None), (None, 1)], "doc_id long, quality int")
    rows = [*good, *bad, (5000, None), (5001, ""), (None, prose(9, 90))]
    machine = quality.train(docs(rows, extra=True), labels)
    got = by_id(quality.score(docs(rows), machine))
    held = [r[0] for r in got.values() if r[0].held_out and r[0].doc_id < 2000]
    assert held and all(r.predicted == (1 if r.doc_id < 1000 else 0) for r in held)
    assert all(0 <= r.score <= 1 for rs in got.values() for r in rs) and got[None][0].held_out is None
    assert got[16][0].held_out == (zlib.crc32(b"16") % 4 == 2)
    kept = quality.keep(docs(rows), machine)
    assert {r.doc_id for r in kept.collect()} >= {i for i, _ in good} and kept.columns == docs(rows).columns
    none = quality.train(docs(rows), labels.where("false"))
    assert {r.predicted for r in quality.score(docs(rows), none).collect()} == {1}


def test_linear_identity_of_interactions():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.1, rng.normal(size=quality.DIM), rng.normal(size=(quality.DIM, 3)))
    feat, x = np.array([3, 70, 900]), np.array([0.5, -1.0, 2.0])
    pairs = sum(m.v[feat[i]] @ m.v[feat[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert m.margins(np.zeros(3, int), feat, x, 1)[0] == pytest.approx(0.1 + m.w[feat] @ x + pairs)


@pytest.mark.parametrize("run", [minhash.near_duplicates, phrases.deduplicate, suffixes.deduplicate, pii.detect, lambda d: bytebpe.digests(d, RANKS), mixing.mix])
def test_empty_tables(docs, run):
    assert run(docs([(1, "x")]).where("false")).count() == 0
