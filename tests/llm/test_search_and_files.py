import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.llm import license_templates as lt
from tidemark.llm import packing, phrase_index, warc
from tidemark.llm.textbytes import Batch

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower_words(t):
    return ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = lower_words(t)
        for p in range(max(1, len(w) - width + 1)) if w else []:
            windows.setdefault(tuple(w[p : p + width]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = lower_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if own := windows.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def brute_near(docs, items, near, width=10):
    out = {}
    for i, t in docs:
        w, found = lower_words(t), set()
        for item, text in items:
            v = lower_words(text)
            for p in range(max(1, len(v) - width + 1)) if v else []:
                need = set(v[p : p + width])
                if any(need <= set(w[s : s + near]) for s in range(max(1, len(w) - near + 1))):
                    found.add(item)
        out[i] = len(found)
    return out


@pytest.mark.parametrize("item_bytes", [1 << 24, 3000])
def test_contamination_equals_brute_force(spark, corpus, item_bytes):
    docs = [(r[0], r[1]) for r in corpus.select("doc_id", "text").collect()]
    long = [t for _, t in docs if len(lower_words(t)) > 100]
    turned = long[1].split()[:10]
    items = [(1, " ".join(long[0].upper().split()[5:40])), (2, " ".join(long[1].split()[:10])), (3, "É́é naïve"), (4, None), (5, ""), (6, "nothing like this"), (10, " ".join(long[2].split()[3:12])), (2, " ".join(long[1].split()[:10])), (11, " ".join(turned[::-1])), (12, " ".join(long[3].split()[:900]))]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, source string")
    got = phrase_index.find_contamination(corpus, table, item_bytes=item_bytes, segment_bytes=5000, near=14, carry=["source", "n_words"]).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == brute_hits(docs, items)
    near = brute_near([d for d in docs if d[0] is not None and docs.count(d) == 1], items, 14)
    ids = [r.doc_id for r in got]
    assert {r.doc_id: r.n_near_items for r in got if ids.count(r.doc_id) == 1 and r.doc_id is not None} == {i: n for i, n in near.items() if ids.count(i) == 1}
    assert sum(near.values()) > sum(r[3] for r in brute_hits([d for d in docs if d[0] in near], items))


def test_items_without_an_id_and_words_that_look_alike(spark):
    """An item without an id counts and has no place in the list; words are compared by their bytes."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    docs = spark.createDataFrame([(1, "x " + b), (2, "x " + a), (3, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "two"), (7, a), (None, "one")], "item_id long, text string")
    got = {r.doc_id: r for r in phrase_index.find_contamination(docs, items).collect()}
    assert [(got[i].n_hit, got[i].n_items, got[i].items_sha256 == hashlib.sha256(k).hexdigest()) for i, k in ((1, b""), (2, b"7"), (3, b""))] == [(0, 0, True), (1, 1, True), (2, 1, True)]


def test_contamination_of_empty_tables(spark, corpus, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert phrase_index.find_contamination(empty, none).count() == 0
    assert not any(r.contaminated for r in phrase_index.find_contamination(corpus, none).collect())


def test_long_phrases_are_whole(spark):
    """A phrase of 140 words is found where all of it stands, once a place; windows may be as long."""
    words = [f"w{i}" for i in range(140)]
    docs = spark.createDataFrame([(1, " ".join(words[:128])), (2, " ".join(["x", *words, "y", *words])), (3, " ".join(words[1:]))], "doc_id long, text string")
    index = phrase_index.index_segments(docs)
    rows = phrase_index.search_index(index, [" ".join(words), "y w0", " ".join(words[:128])]).collect()
    assert sorted((r.phrase, r.doc_id, r.position) for r in rows) == [(0, 2, 1), (0, 2, 142), (1, 2, 141), (2, 1, 0), (2, 2, 1), (2, 2, 142)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    found = {r.doc_id: (r.n_hit, r.contaminated) for r in phrase_index.find_contamination(docs, items, width=130).collect()}
    assert found == {1: (0, False), 2: (280, True), 3: (139, True)}


def test_stored_index_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "c b a x x x x d"), (3, "b"), (4, None)], "doc_id long, text string")
    index = phrase_index.index_segments(docs, segment_bytes=10)
    rows = phrase_index.search_index(index, ["b C", "x x", "a d"], near=4).collect()
    assert sorted((r.doc_id, r.phrase, r.position) for r in rows if r.kind == "exact") == [(1, 0, 1), (2, 1, 3), (2, 1, 4), (2, 1, 5)]
    assert sorted((r.doc_id, r.phrase) for r in rows if r.kind == "near") == [(1, 0), (1, 2), (2, 0), (2, 1)]
    far = phrase_index.search_index(index, ["a d"], near=6)
    assert sorted(r.doc_id for r in far.where("kind = 'near'").collect()) == [1, 2]
    assert {t.decode() for r in index.collect() for t in r.terms} == set("abcdefx")  # every word is indexed


@pytest.fixture(scope="module")
def pages(spark):
    html = ["<p>same</p>", "<p>ü</p>", "", None, "x" * 900_000, "<p>same</p>", "", "<p>same</p>"]
    rows = [(i * 3 - 2, f"http://a/{i}\r\nX: y" if i % 2 else None, h, "z") for i, h in enumerate(html)]
    return spark.createDataFrame([*rows, (None, "u", "<p>same</p>", "z"), (-2, "u", "<p>same</p>", "z")], "page_id long, url string, html string, digest string").repartition(3)


def test_archives_round_trip(spark, pages, tmp_path):
    warc.write_archives(pages, str(tmp_path / "a"), frame_bytes=100, bundle_bytes=3000)
    rows = {(r.page_id, r.record_type): r for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    texts = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    least = {}
    for i, t in texts:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    for i, t in texts:
        again = i is not None and i > least[t]
        r = rows[i, "revisit" if again else "response"]
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(t), base64.b32encode(hashlib.sha1(t).digest()).decode(), least[t] if again else None)
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b").count() == 0


def test_bundles_are_plain_zstandard_files_and_seekable(spark, pages, tmp_path):
    folder = str(tmp_path / "c")
    index = warc.write_archives(pages.where("page_id > -2"), folder, frame_bytes=50).collect()
    assert {r.file for r in index} == {p.name for p in (tmp_path / "c").glob("*.warc.zst")} and index
    for r in index:
        data = (tmp_path / "c" / r.file).read_bytes()
        text = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert text.count(b"WARC/1.1\r\n") == len(r.record_ids)
        read = lambda n, at, d=data: d[at : at + n]
        reader = warc.BundleReader(read, len(data))
        assert reader.at[-1] == len(data) - 17 - 8 * len(reader.plain) and len(text) == sum(reader.plain)
        for rid, f, o, n in zip(r.record_ids, r.frames, r.offsets, r.lengths):
            assert warc.parse_record(reader.read(f, o, n))["warc"]["warc-record-id"] == f"<{rid}>"
    (tmp_path / "c" / "part-000000-0000-999999.warc.zst").write_bytes(b"left by a lost task")
    warc.index_records(spark, folder)
    assert [r.page_id for r in warc.look_up(spark, folder, [4]).collect()] == [4]
    assert sorted(r.page_id for r in warc.look_up(spark, folder, [4, 1, 999]).collect()) == [1, 4]
    plan = spark.read.parquet(f"{folder}/records").where("page_id = 4")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(page_id), EqualTo(page_id,4)]" in plan
    with pytest.raises(ValueError):
        warc.BundleReader(lambda n, at: b"no bundle at all"[at : at + n], 16)


def test_a_record_is_read_from_the_footer_and_one_frame(spark, tmp_path):
    """A frame that is damaged, or a footer, matters to its own records alone, and to all."""
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    folder = str(tmp_path / "d")
    warc.write_archives(pages, folder, frame_bytes=1000)
    warc.index_records(spark, folder)
    (file,) = (tmp_path / "d").glob("*.warc.zst")
    data = bytearray(file.read_bytes())
    reader = warc.BundleReader(lambda n, at: bytes(data[at : at + n]), len(data))
    data[reader.at[3] + 10 : reader.at[4]] = b"?" * (reader.at[4] - reader.at[3] - 10)
    file.write_bytes(bytes(data))
    (tmp_path / "d" / f".{file.name}.crc").unlink(missing_ok=True)
    frames = {r.page_id: r.frame for r in spark.read.parquet(f"{folder}/records").collect()}
    fine = [p for p, f in frames.items() if f != 3]
    assert sorted(r.page_id for r in warc.look_up(spark, folder, fine).collect()) == sorted(fine)
    with pytest.raises(PySparkException):
        warc.look_up(spark, folder, [p for p, f in frames.items() if f == 3]).collect()
    file.write_bytes(bytes(data[:-4]) + b"????")
    with pytest.raises(PySparkException):
        warc.look_up(spark, folder, fine[:1]).collect()


def test_spread_places_every_length_once():
    rng = np.random.default_rng(1)
    counts = {int(k): int(v) for k, v in zip(rng.integers(1, 4097, 300), rng.integers(1, 50, 300))}
    patterns = packing.spread(counts, 4096)
    seen = {}
    for n, p in patterns:
        assert sum(p) <= 4096
        for length in p:
            seen[length] = seen.get(length, 0) + n
    assert seen == counts and len(patterns) <= 2 * len(counts)
    packs = sum(n for n, _ in patterns)
    assert packs * 4096 < 1.1 * sum(k * v for k, v in counts.items()) + 4096


def test_packing_of_odd_documents(spark, corpus, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    odd = spark.createDataFrame([(900, "it's <|endoftext|> don't x…!? 12.5% İstanbul ß²"), (901, "a" * 30_000), (902, "<|STARTOFTEXT|>b")], "doc_id long, text string")
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    odd = odd.unionByName(spark.createDataFrame([(903, f"{a} x {b}"), *[(None, f"{b}1 y")] * 30, *[(904, "same")] * 30], "doc_id long, text string"))
    docs = corpus.select("doc_id", "text").unionByName(odd)
    rows = packing.pack(docs, path, room=512).collect()
    tokenizer = Tokenizer.from_file(path)
    want = {}
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), 512):
            k = (r.doc_id, s, min(512, len(ids) - s), zlib.crc32(np.array(ids[s : s + 512], "<u4").tobytes()), len(ids))
            want[k] = want.get(k, 0) + 1
    got = {}
    for r in rows:
        got[tuple(r)[:5]] = got.get(tuple(r)[:5], 0) + 1
    assert got == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(empty, path).count() == 0


def test_templates_compile_and_match(spark):
    a = lt.Automaton("x", "grant [[ of {{thing 1-2}} ]] is {{name 0-2}} free")
    accept = lambda t: a.accepts_from(t.split(), 0, len(t.split()))
    assert [accept(t) for t in ("grant is free", "grant of a is free", "grant of a b is x free", "grant of is free", "grant of a b c is free", "grant is x y z free", "grant")] == [3, 5, 7, None, None, None, None]
    for bad in ("[[ a ]] b", "a [[ b", "a ]] b", "a {{n 3-1}}", "{{n 1-2}} a"):
        with pytest.raises(ValueError):
            lt.parse(bad)
    docs = spark.createDataFrame([(1, "Under the MIT License!\nunder THE mit-license", "x"), (2, None, "x"), (3, "", "x"), (4, "licensed under the GNU General Public License, version 3.", "x"), (5, "SPDX-License-Identifier: BSD-3-Clause", "x")], "doc_id long, text string, labels string")
    rows = {r.doc_id: r for r in lt.scan(docs).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].base_labels) == (2, 0, 4, "mit")
    assert (rows[2].n_words, rows[2].first_word, rows[2].labels, rows[2].score) == (0, None, "", 0.0)
    assert rows[4].labels == "gpl-3" and rows[5].labels == "spdx" and 0 < rows[5].score < 1
    assert lt.scan(docs.limit(0)).count() == 0


def test_long_texts_are_tokenized_in_parts():
    text = " ".join(["word", "é", "<|endoftext|>", "don't"] * 50) + "\n" + "x" * 700 + " end"
    parts = packing.parts_of(pa.array([text]), 100)
    assert "".join(p[0].as_py() for p in parts) == text and len(parts) > 8
    assert [p[0].as_py() for p in packing.parts_of(pa.array(["x" * 500]), 100)] == ["x" * 500]
    P = pytest.importorskip("public_tokenizers")
    words = packing.WordIds(P.path("word_bpe_49k.json"))
    ids = np.concatenate([words.of(Batch(p))[0] for p in parts])
    assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def filled(template):
    """A text of the template: gaps get their least words, optional regions are left out."""
    return " ".join(x.text if isinstance(x, lt.Word) else " ".join(["thing"] * x.least) for x in lt.parse(template) if not isinstance(x, lt.Optional))


def test_whole_licenses_and_altered_ones(spark):
    """Every wording is accepted as it is; with a word of its own in the terms, only its opening is."""
    rows, want = [], {}
    for i, (label, template) in enumerate(lt.TEMPLATES):
        rows.append((i, f"Copyright X. {filled(template).title()}! end"))
        want[i] = label
    mit = filled(dict(lt.TEMPLATES)["mit"])
    rows += [(100, mit.replace("without restriction", "for good and not evil without restriction")), (101, mit[:-20]), (102, mit + " " + mit), (103, "permission is hereby " * 500)]
    got = {r.doc_id: r.labels.split(",") for r in lt.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[i] in got[i] for i in want)
    assert (got[100], got[101], got[102], got[103]) == (["mit-opening"], ["mit-opening"], ["mit", "mit-opening"], [""])


def test_segments_are_a_row_group_each(spark):
    """Neither the task that writes an index nor one that reads it holds more than a row group: no segment waits for the next hundred."""
    docs = spark.range(24).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 20000), x -> sha2(concat(id, '-', x), 256)), ' ')").alias("text")).coalesce(1)
    files = phrase_index.index_segments(docs, segment_bytes=1 << 16, carry=["text"]).inputFiles()
    found = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    assert sum(m.num_rows for m in found) == 24
    assert sum(m.num_row_groups for m in found) > 2  # one group of all before
