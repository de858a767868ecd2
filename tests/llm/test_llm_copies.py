"""Line dedup, SimHash, packing, token files, top-k, urls and the pipeline."""

import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from check_oracles import canonical
from sessionlake.llm import (
    components,
    decontaminate,
    line_dedup,
    mixing_coder,
    packing,
    queries,
    simhash,
    token_file,
    tokens,
    top_k,
    url_filter,
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, name, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    ours = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    assert ours == canonical(columns, cursor.fetchall())


# --- line dedup --------------------------------------------------------------


def plain_dedup(rows, min_sites):
    sites, first = {}, {}
    for doc_id, text, source in rows:
        for n, line in enumerate((text or "").split("\n") if text is not None else ()):
            key = line.strip(" ")
            if key:
                sites.setdefault(key, set()).update({source} - {None})
                first.setdefault(key, []).append((doc_id, n))
    for doc_id, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        kept = [
            line
            for n, line in enumerate(lines)
            if not line.strip(" ") or len(sites[line.strip(" ")]) < min_sites or min(first[line.strip(" ")]) == (doc_id, n)
        ]
        yield doc_id, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)


def test_line_dedup_near_the_threshold(spark):
    """Lines on 1 to 40 sites, with a hot line and lines repeated inside one document."""
    rows = [
        (d, "\n".join(["hot"] + [f"on {k} sites" for k in range(1, 41) if d < k] + [" ", "", f"own {d}", "hot "]), f"s{d}")
        for d in range(40)
    ]
    rows += [(100, None, "s1"), (101, "", "s2"), (102, "hot", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for min_sites in (1, 7, 8, 20):
        found = line_dedup.dedup_lines(frame, min_sites).select("doc_id", "n_lines", "n_removed", "text")
        assert sorted(map(tuple, found.collect())) == sorted(plain_dedup(rows, min_sites))


def test_line_dedup_is_native(spark):
    plan = queries.op7_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_line_dedup_of_odd_rows(odd, none):
    out = line_dedup.dedup_lines(odd, 2, n_lines="lines_", n_removed="gone_")
    assert out.count() == odd.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    # The long text stands on two sites; its first occurrence stays.
    assert len(texts[5]) > 100_000 and texts[6] == "" and texts[2] is None and texts[3] == ""
    assert [r.text for r in out.where("doc_id = 1").collect()] == ["the cat sat on the mat"] * 2
    kept = line_dedup.drop_boilerplate(odd, 2)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert line_dedup.drop_boilerplate(none).count() == 0


# --- SimHash -----------------------------------------------------------------


def plain_fingerprint(text):
    found = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split() if w]
    parts = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, distance):
    root = dict(zip(ids, ids))
    while True:
        before = dict(root)
        for (a, x), (b, y) in combinations(zip(ids, prints), 2):
            if (x ^ y).bit_count() <= distance:
                root[a] = root[b] = min(root[a], root[b])
        if before == root:
            return root


def test_near_duplicates_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    root = plain_components([r.doc_id for r in rows], prints, 2)
    found = queries.op10_simhash(spark, SF).collect()
    assert sorted(map(tuple, found)) == [
        (r.doc_id, f"{p:016x}", root[r.doc_id]) for r, p in zip(rows, prints)
    ]


@pytest.fixture(scope="module")
def crowd(spark):
    """Fingerprints in dense groups, so that large buckets and many links occur."""
    rng = np.random.default_rng(5)
    values = set()
    for center in rng.integers(0, 1 << 63, 3):
        for _ in range(70):
            value = int(center)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                value ^= 1 << int(bit)
            values.add(value if value < 1 << 63 else value - (1 << 64))
    pairs = {
        (a, b) for a, b in combinations(sorted(values), 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    }
    assert len(pairs) > 300
    return spark.createDataFrame([(v,) for v in sorted(values)], "fp long"), pairs


UNEQUAL = [[(list(range(30)), 1), (list(range(30, 64)), 0)], [(list(range(64)), 2)], None]


@pytest.mark.parametrize("parts", UNEQUAL)
@pytest.mark.parametrize("bucket_rows", [512, 4])
def test_links_lose_none(crowd, parts, bucket_rows):
    frame, pairs = crowd
    found = simhash.links(frame, 2, bucket_rows, parts)
    assert {tuple(r) for r in found.collect()} == pairs


def test_allocation_keeps_the_pigeonhole_sum():
    work = [{-1: 0.0, 0: 9.0, 1: 90.0}, {-1: 0.0, 0: 1.0, 1: 2.0}, {-1: 0.0, 0: 50.0, 1: 99.0}]
    cost, thresholds = simhash.allocate(work, 0)
    assert sum(thresholds) == 0 and thresholds == [0, 1, -1] and cost == 11.0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(1300, 1299), (5, 5)]
    found = components.connected_components(spark.createDataFrame(chain + star, "a long, b long"))
    assert dict(map(tuple, found.collect())) == {
        **{i: 0 for i in range(1, 201)},
        **{1000 + i: 1000 for i in range(1, 301)},
    }


def test_near_duplicates_of_odd_rows(odd, none):
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(odd).collect()}
    zero = "0" * 16
    assert found[2, zero] == found[3, zero] == found[4, zero] == found[None, zero] == 2
    kept = simhash.keep_one(odd)
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert kept.columns == odd.columns and ids == [1, 2, 5, 7, 8, 9, None]
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


# --- tokens, packing and token files -----------------------------------------


def test_pieces_equal_the_library(library):
    texts = [
        "", None, "It's they'll  two   spaces \n\n tab\t x²Ⅷ_!? ¿Qué? naïve",
        "<|endoftext|> is text", "中文かなカナ한글 Привет", "\x1c\x85\u3000 odd\u00a0space\u200b",
        "مرحبا नमस्ते 😀👍🏽", "a" * 500 + " " * 70 + "1" * 90, "'s''s 's!'s",
    ]
    texts += [" " * 5000 + "a", "\n" * 199 + "b", "word" * 5000, " x\n y  z "]
    state = {}
    for _ in range(2):
        encoder = tokens.Encoder(tokens.vocabulary_path(), state)
        found = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)]
        assert found == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_parts_of_every_character_equal_the_library(library):
    import re

    chars = [c for c in map(chr, range(0x10000)) if re.match(f"[{tokens.SCRIPTS}]", c)]
    texts = [f"a{c}1 {c}{c}'s{c}'ll !'re{c}  {c}\n{c}'x{c} " for c in chars] + ["'", "a'", "'l", "'s'd've ' s"]
    found = tokens.Encoder(tokens.vocabulary_path()).encode(texts)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [w.ids for w in want]


def test_each_part_is_encoded_once(library, monkeypatch):
    given = []
    encode = tokens.tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(
        tokens.tiktoken.Encoding, "encode_ordinary", lambda self, text: given.append(text) or encode(self, text)
    )
    texts = ["the cat's sat on the été. \n" * 500, "the cat's sat", "", None, " the été\n\n"] * 3
    found = tokens.Encoder(tokens.vocabulary_path()).encode(texts)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [
        library.encode(t or "", add_special_tokens=False).ids for t in texts
    ]
    assert sum(map(len, given)) < 100


def test_long_texts_in_windows(library, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_CHARS", 50)
    texts = ["It's a  dog \n 12 b. c D e f " * 40, "x" * 300, "one two", " y z" * 60, "a\u00e9 " * 99]
    found = tokens.Encoder(tokens.vocabulary_path()).encode(texts)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [w.ids for w in want]
    assert len(list(tokens.windows(texts[0], 50))) > 10


def test_ranks_only_of_byte_level_vocabularies():
    import json

    with open(tokens.vocabulary_path(), encoding="utf-8") as file:
        vocabulary = json.load(file)
    table = tokens.ranks(vocabulary)
    assert len(table) == 50_256 and table[b" the"] == vocabulary["model"]["vocab"]["\u0120the"]
    assert tokens.ranks({**vocabulary, "normalizer": {"type": "Lowercase"}}) is None
    vocabulary["model"]["merges"].reverse()
    assert tokens.ranks(vocabulary) is None
    other = tokens.Encoder(tokens.vocabulary_path("word_bpe_49k.json"))
    assert other.fast is None and other.encode(["two words", None])[1] == b""


def plain_ids(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def check_packing(rows, library, found, capacity):
    ids = {r.doc_id: plain_ids(library, r.text) for r in rows}
    cut, places = {}, {}
    for p in found:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert zlib.crc32(part.tobytes()) == p.ids_crc32 and len(part) == p.length <= capacity
        cut.setdefault(p.doc_id, []).append((p.piece, p.start, p.length))
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for doc_id, mine in ids.items():
        at = 0
        for n, (piece, start, length) in enumerate(sorted(cut[doc_id])):
            assert (piece, start) == (n, at) and (n == 0 or length == capacity)
            at += length
        assert at == len(mine)
    for content in places.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_of_documents(spark, library, capacity):
    frame = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    found = packing.pack_documents(frame, capacity).collect()
    n = check_packing(frame.collect(), library, found, capacity)
    counts = np.bincount([p.length for p in found], minlength=capacity + 1)
    assert packing.lower_bound(counts, capacity) <= n <= packing.lower_bound(counts, capacity) * 1.01 + 1


def fewest(sizes, capacity):
    """The fewest bins, by search."""
    best = [len(sizes)]

    def place(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(sizes):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[at] <= capacity and bins[i] not in bins[:i]:
                place(at + 1, [*bins[:i], bins[i] + sizes[at], *bins[i + 1 :]])
        place(at + 1, [*bins, sizes[at]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_best_packing_possible():
    rng = np.random.default_rng(11)
    fixed = 0
    for _ in range(150):
        capacity = int(rng.integers(6, 24))
        sizes = sorted(rng.integers(1, capacity + 1, rng.integers(1, 10)).tolist(), reverse=True)
        counts = np.bincount(sizes, minlength=capacity + 1)
        left, bins = counts.copy(), packing.Bins(capacity)
        done = packing.reduce(left, capacity, bins)
        rest = [k for k in range(capacity, 0, -1) for _ in range(int(left[k]))]
        assert done + fewest(rest, capacity) == fewest(sizes, capacity)
        assert packing.lower_bound(counts, capacity) <= fewest(sizes, capacity)
        packed = packing.pack(counts, capacity)
        assert sum(n for n, _ in packed.groups) >= fewest(sizes, capacity)
        fixed += done
    assert fixed > 200


def test_packing_and_token_file_of_odd_rows(spark, odd, none, library, tmp_path):
    unique = odd.where("doc_id > 1")
    check_packing(unique.collect(), library, packing.pack_documents(unique).collect(), 2048)
    assert packing.pack_documents(odd).where("doc_id = 1").count() == 2
    assert packing.pack_documents(none).count() == 0
    token_file.write(odd, str(tmp_path / "odd"), segment_ids=50)
    found = token_file.read_ids(spark, str(tmp_path / "odd")).orderBy("start").collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    at = 0
    for row in found:
        ids = row.ids if row.doc_id is None else plain_ids(library, texts[row.doc_id]).tolist()
        assert row.ids == ids and row.start == at and row.n_tokens == len(ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert [r.doc_id for r in found] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    token_file.write(none, str(tmp_path / "none"))
    assert token_file.read(spark, str(tmp_path / "none")).count() == 0


def test_token_file_of_documents(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want, at = [], 0
    for row in rows:
        ids = plain_ids(library, row.text)
        want.append((row.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op5_token_file(spark, SF).collect())) == want


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_coder_round_trip(block):
    rng = np.random.default_rng(block)
    streams = [
        np.zeros(0, int), np.array([65535]), rng.integers(0, 65536, 3000), np.full(3000, 77),
        np.tile(rng.integers(0, 500, 50), 60), rng.geometric(0.01, 5000) % 65536,
    ]
    for ids in streams:
        blocks = mixing_coder.encode(ids, block)
        assert mixing_coder.decode(blocks).tolist() == ids.tolist()
        if blocks:  # each block stands alone
            assert mixing_coder.decode(blocks[-1:]).tolist() == ids[(len(blocks) - 1) * block :].tolist()
    repeated = sum(len(b[2]) for b in mixing_coder.encode(np.tile(np.arange(100, 150), 200), 1024))
    assert repeated < 0.3 * 2 * 10_000


def test_coder_of_unlikely_ids():
    """After runs that make them unlikely, ids narrow the range as far as they can."""
    rng = np.random.default_rng(5)
    for extra in range(64):
        teach = [0xC000 + rng.integers(0, 0x1FFF, 80), 0x8000 + rng.integers(0, 0x3FFF, 80), rng.integers(0, 0x7FFF, 80)]
        again = np.full(200 + extra, 5)
        ids = np.concatenate([*teach, again, [0xFFFF - extra], again, [0xE000]])
        assert mixing_coder.decode(mixing_coder.encode(ids)).tolist() == ids.tolist()


def test_coder_in_groups_of_blocks(monkeypatch):
    ids = np.random.default_rng(6).geometric(0.01, 1000) % 65536
    whole = mixing_coder.encode(ids, 64)
    monkeypatch.setattr(mixing_coder, "LANES", 3)
    assert mixing_coder.encode(ids, 64) == whole
    assert mixing_coder.decode(whole[::-1][:5]).tolist() == np.concatenate(
        [ids[at * 64 : at * 64 + 64] for at in (15, 14, 13, 12, 11)]
    ).tolist()


def test_coder_refuses_damage_and_large_ids():
    n, crc, coded = mixing_coder.encode(np.arange(300))[0]
    with pytest.raises(ValueError, match="checksum"):
        mixing_coder.decode([(n, crc, coded[:20] + bytes([coded[20] ^ 8]) + coded[21:])])
    with pytest.raises(ValueError, match="65535"):
        mixing_coder.encode(np.array([70_000]))


# --- top-k -------------------------------------------------------------------


def plain_top(rows, modulus, k):
    whole = []
    for vec_id, vector in rows:
        if vec_id is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        whole.append((vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in vector]))
    for query_id, q in whole:
        if query_id % modulus == 0:
            scores = sorted(
                (-sum(a * b for a, b in zip(q, v)), vec_id) for vec_id, v in whole if vec_id != query_id
            )
            for rank, (score, vec_id) in enumerate(scores[:k], 1):
                yield query_id, rank, vec_id, -score


@pytest.mark.parametrize("block", [8192, 10])
def test_top_k_of_unlike_lengths(spark, block, monkeypatch):
    monkeypatch.setattr(top_k, "BUCKET", 16)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        center = np.eye(8)[i % 3] * 3
        vector = (center + rng.normal(0, 0.4, 8)) * rng.choice([0.01, 0.3, 1, 5])
        rows.append((i, [float(np.float32(x)) for x in vector]))
    rows += [(400, rows[7][1]), (401, None), (402, [1.0, None]), (403, [float("nan")]), (404, [float("inf")])]
    rows += [(405, [0.0] * 8), (406, []), (None, [1.0] * 8), (420, [0.0] * 8), (425, [0.5, -0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    found = top_k.top_k(frame, F.col("vec_id") % 5 == 0, 5, block)
    assert sorted(map(tuple, found.collect())) == sorted(plain_top(rows, 5, 5))


def test_top_k_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert [tuple(r) for r in top_k.top_k(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 131072)]
    empty = two.where("false")
    assert top_k.top_k(empty, F.col("vec_id") == 0).count() == 0


# --- urls --------------------------------------------------------------------


def test_rules_and_parts_of_urls(spark):
    cases = [
        ("http://Shop.COM/x", "shop.com", "/x", "com/", "allow"),
        ("https://a.example.com/en/1?q#f", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://b.www.example.com/en/", "b.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("x://net/es/", "net", "/es/", "net/es/", "block"),
        ("x://a.net/fr/y#z", "a.net", "/fr/y", "net/fr/", "block"),
        ("x://notcom/", "notcom", "/", None, None),
        ("x://shop.com", "shop.com", "", None, None),
        ("x://h?a://b", "h", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("x://É.com/", "É.com", "/", "com/", "allow"),
    ]
    frame = spark.createDataFrame([(i, c[0], None, 1) for i, c in enumerate(cases)], "page_id long, url string, html string, score long")
    found = {r.page_id: r for r in url_filter.judge_urls(frame.drop("score")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule)
        assert found[i].verdict == verdict if verdict else found[i].verdict in ("allow", "block")
    assert url_filter.judge_urls(frame.where("false").drop("score")).count() == 0


def test_viterbi_is_the_best_split():
    scores = {"spam": -3.0, "farm": -3.5, "sp": -5.0, "am": -4.0, "amfa": -9.0, "rm": -6.0, "a": -2.0}
    name, total = "spamfarmx", 1e5
    known = {(a, b): scores[name[a:b]] for a, b in combinations(range(len(name) + 1), 2) if name[a:b] in scores}

    def cost(word):
        return scores.get(word, -np.log(total) - len(word) * np.log(10))

    splits = [
        [name[a:b] for a, b in zip((0, *cut), (*cut, len(name)))]
        for n in range(len(name))
        for cut in combinations(range(1, len(name)), n)
    ]
    best = max(splits, key=lambda words: sum(map(cost, words)))
    assert url_filter.viterbi(name, known, total) == best == ["spam", "farm", "x"]


def test_urls_by_naive_bayes(spark):
    """The whole method in plain Python over the given pages."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = {r.page_id: r for r in queries.op2_url_filter(spark, SF).collect()}
    counts, total = {}, 0
    unseen = re.compile(r"<(script|style)\b.*?</\1>|<[^>]*>", re.DOTALL | re.IGNORECASE)
    for row in rows:
        for word in url_filter._WORD.findall(unseen.sub(" ", row.html or "").lower()):
            counts[word] = counts.get(word, 0) + 1
            total += 1
    total += 1

    def words(name):
        if name == "#":
            return ["#"]
        known = {
            (a, b): np.log(counts[name[a:b]] / total)
            for a, b in combinations(range(len(name) + 1), 2)
            if name[a:b] in counts and b - a <= url_filter.LONGEST_WORD
        }
        return url_filter.viterbi(name, known, total)


    seen, of_page = {}, {}
    for row in rows:
        got = found[row.page_id]
        runs = re.findall(r"[^\W\d_]+|\d+", f"{got.host}/{got.path}".lower())
        of_page[row.page_id] = [w for r in runs for w in words("#" if r[0].isdigit() else r)]
        if got.rule:
            for token in of_page[row.page_id]:
                seen.setdefault(token, {"allow": 0, "block": 0})[got.verdict] += 1
        for token in of_page[row.page_id]:
            seen.setdefault(token, {"allow": 0, "block": 0})
    sums = {v: sum(s[v] for s in seen.values()) + len(seen) for v in ("allow", "block")}
    ruled = [r.verdict for r in found.values() if r.rule]
    prior = np.log((ruled.count("block") + 1) / (ruled.count("allow") + 1))
    for page_id, got in found.items():
        score = prior + sum(
            np.log((seen[t]["block"] + 1) / sums["block"]) - np.log((seen[t]["allow"] + 1) / sums["allow"])
            for t in of_page[page_id]
        )
        assert got.score == pytest.approx(score)
        assert got.rule or got.verdict == ("block" if score > 0 else "allow")


# --- pipeline ----------------------------------------------------------------


def test_stages_of_the_pipeline(spark, library, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    assert all(frame.columns == columns for frame in kept[:-1])
    rows = [frame.collect() for frame in kept]
    ids = [{r.doc_id for r in stage} for stage in rows]
    assert len(ids[1]) >= 0.98 * len(ids[0])
    want = {d: t for d, _, n, t in plain_dedup([(r.doc_id, r.text, r.source) for r in rows[1]], line_dedup.MIN_SITES) if not n or t.strip(" ")}
    assert {r.doc_id: r.text for r in rows[2]} == want
    root = plain_components([r.doc_id for r in rows[2]], [plain_fingerprint(r.text) for r in rows[2]], 2)
    assert ids[3] == set(root.values())
    found = decontaminate.digests(decontaminate.find_contamination(kept[3], spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert ids[4] == {r.doc_id for r in found.collect() if not r.contaminated}
    check_packing(rows[4], library, rows[5], 2048)
    run = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in run.collect()} == ids[4]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, odd, none, empty):
    docs = none if empty else odd
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() >= (0 if empty else 1)
