"""Merkle manifest, filter audit and SentencePiece ids against plain versions."""

import hashlib
import re
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from check_oracles import canonical, database
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from sessionlake.llm import filter_audit, merkle, queries, sentence_pieces

NAMES = ("op11_merkle", "op12_filter_audit")


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, sf):
    sf_dir = f"/root/testdata/{sf}"
    frame = queries.QUERIES[name](spark, sf_dir)
    cursor = database(sf_dir).execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert canonical(frame.columns, map(tuple, frame.collect())) == canonical(columns, cursor.fetchall())


# --- Merkle manifest ---------------------------------------------------------


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests):
    """The digest at the top, and the siblings (before, after) of each digest level by level."""
    ways, held = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above = []
        for low in range(0, len(digests), 16):
            run = digests[low : low + 16]
            for at in range(len(run)):
                for each in held[low + at]:
                    ways[each].append(("".join(run[:at]), "".join(run[at + 1 :])))
            above.append((sha(*run), sum(held[low : low + 16], [])))
        digests, held = map(list, zip(*above))
    return digests[0], ways


def plain_manifest(rows):
    by_source = defaultdict(list)
    for row in rows:
        by_source[row["source"]].append((row["doc_id"], plain_leaf(row, row["text"]), row))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in sources:
        by_source[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[source] = plain_tree([leaf for _, leaf, _ in by_source[source]])
    root, ways_up = plain_tree([trees[s][0] for s in sources])
    for source, way_up in zip(sources, ways_up):
        for (doc_id, leaf, row), way in zip(by_source[source], trees[source][1]):
            text = row["text"]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            folded, way = plain_leaf(row, text), way + way_up
            for before, after in way:
                folded = sha(before, folded, after)
            siblings = sha(*(before + after for before, after in way))
            yield doc_id, leaf, trees[source][0], root, siblings, folded, folded == root


def manifest(documents):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.verify(merkle.manifest(documents, tampered, merkle.lower_ascii(F.col("text"))))


def check_manifest(documents):
    found = sorted(map(tuple, manifest(documents).collect()), key=repr)
    want = sorted(plain_manifest([r.asDict() for r in documents.collect()]), key=repr)
    assert found == want
    return found


def test_manifest_of_uneven_sources(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_OF_KEY", 4)  # salts at far ancestors
    monkeypatch.setattr(merkle, "FANOUT", 16)
    sizes = {"hot": 5000, "é": 17, "one": 1, None: 256, "": 16, "z": 15}
    rows = [(n * 7 % 9973, f"Text {n}", s, "en", n) for s, size in sizes.items() for n in range(size)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    found = check_manifest(documents.repartition(5))
    assert {row[-1] for row in found} == {True, False}


def test_manifest_of_odd_rows(odd, none):
    check_manifest(odd)
    assert manifest(none).collect() == [] and manifest(none).columns == manifest(odd).columns
    lone = odd.where("doc_id = 8")
    (row,) = manifest(lone).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha()


# --- filter audit ------------------------------------------------------------


def plain_audit(documents, labels):
    first, good, toxic = {}, set(), set()
    for row in documents:
        if row.doc_id is not None:
            text = row.text or ""
            first[text] = min(first.get(text, row.doc_id), row.doc_id)
    for row in labels:
        good.update([row.doc_id] if row.quality == 1 else [])
        toxic.update([row.doc_id] if row.toxic == 1 else [])
    fails, parts = [], sorted({row.lang or "" for row in documents})
    for row in documents:
        text = row.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words)}
        found["C"] = 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)
        found["D"] = re.search("[#$%&*|]", text) is not None
        found["E"] = row.doc_id is not None and row.doc_id > first[text]
        of = {f for f, bad in found.items() if bad}
        fails.append((row.lang or "", of, row.doc_id in good - {None}, row.doc_id in toxic - {None}))
    shapley, rows = Counter(), []
    for part in parts:
        mine = [f[1:] for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [m for m in left if name in m[0]]
                redundant = sum(name in of for of, *_ in mine) - len(gone)
                left = [m for m in left if name not in m[0]]
                alone = sum(of == {name} for of, *_ in mine)
                shapley[part, name] += len(gone)
                rows.append((part, order, step, len(left), len(gone), redundant, alone, sum(g for _, g, _ in gone), sum(t for *_, t in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def test_audit_of_odd_rows(spark, odd, none):
    extra = [
        (20, "SHOUT # SHOUT", "en", "a", 1, 0.5, "x", 7),
        (21, "SHOUT # SHOUT", "fr", "a", 1, 0.5, "x", 7),
        (19, "SHOUT # SHOUT", "", "a", 1, 0.5, "x", 7),
    ]
    documents = odd.union(spark.createDataFrame(extra, odd.schema))
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (20, None, 1), (None, 1, 1), (6, 1, None), (99, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    found = sorted(map(tuple, filter_audit.audit(documents, labels).collect()))
    assert found == plain_audit(documents.collect(), labels.collect())
    assert filter_audit.audit(none, labels).count() == 0
    assert filter_audit.audit(odd, labels.where("false")).where("good_lost + toxic_lost > 0").count() == 0


# --- SentencePiece -----------------------------------------------------------

ODD_TEXTS = [
    "", " ", "  ", "a", " a", "a  b ", "a\n b", "▁x", "x▁▁y ▁", "a　b\xa0c", "ﬁ", "</s> <s> <unk>",
    "中文 \U0001f600", "\x00z", "﻿q", "é \r\n\t z", " " * 70 + "x", "word" * 20_000, "<0x41> ▁ ▁▁",
]


@pytest.fixture(scope="module")
def pieces():
    return SentencePieceProcessor(model_file=sentence_pieces.model_path())


@pytest.mark.parametrize("held_chunks", [0, 300_000])
def test_ids_equal_the_library(spark, pieces, odd, held_chunks):
    rows = odd.union(spark.createDataFrame([(100 + n, t, "", "", 0, 0.5, "", 0) for n, t in enumerate(ODD_TEXTS)], odd.schema))
    encoded = sentence_pieces.encode(rows, held_chunks=held_chunks)
    found = sentence_pieces.decode(encoded)
    want = [(r.doc_id, pieces.encode(r.text or "", add_eos=True)) for r in rows.collect()]
    want = [(doc_id, ids, pieces.decode(ids)) for doc_id, ids in want]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    digests = {r.doc_id: r for r in sentence_pieces.digests(found).collect()}
    for doc_id, ids, text in want:
        if doc_id and doc_id >= 100:
            row = digests[doc_id]
            assert row.n_tokens == len(ids) and row.ids_sha256 == sha(" ".join(map(str, ids)))
            assert row.decoded_sha256 == sha(text)


def test_ids_of_documents(spark, pieces):
    sf_dir = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op13_sentence_pieces(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(rows)
    for row in rows:
        ids = pieces.encode(row.text or "", add_eos=True)
        text = pieces.decode(ids)
        want = (row.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(text))
        assert tuple(found[row.doc_id]) == want


def test_table_segments_each_chunk_once(pieces):
    class Counting:
        def __init__(self):
            self.seen = Counter()

        def __getattr__(self, name):
            return getattr(pieces, name)

        def encode(self, texts, **options):
            self.seen.update(texts if isinstance(texts, list) else [])
            return pieces.encode(texts, **options)

    model = Counting()
    table = sentence_pieces.ChunkTable(model, 1000)
    table.encode(["the cat the cat", "the dog"])
    (found,) = table.encode(["a cat  the"])
    assert array("i", found).tolist() == pieces.encode("a cat  the")
    assert max(model.seen.values()) == 1


def test_models_that_cross_markers_get_whole_texts(pieces):
    class Crossing:
        def __getattr__(self, name):
            return getattr(pieces, name)

        def id_to_piece(self, at):
            return "of▁the" if at == 400 else pieces.id_to_piece(at)

    table = sentence_pieces.ChunkTable(Crossing(), 1000)
    (found,) = table.encode(["x y"])
    assert not table.alone and not table.held and array("i", found).tolist() == pieces.encode("x y")


def test_sentence_pieces_of_no_rows(none):
    found = sentence_pieces.digests(sentence_pieces.decode(sentence_pieces.encode(none)))
    assert found.collect() == []
