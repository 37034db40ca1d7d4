"""Every stage of the pipeline against a plain version on a small table, and the whole on one folder."""

import collections
import re
import zlib

import pytest

pytest.importorskip("pitpanel.llm")
import corpus_pipeline as P  # noqa: E402

from pitpanel.llm import pii  # noqa: E402
from pitpanel.llm.queries import vocabulary  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _kept_id int, pii_email int"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a very old oak tree near the river"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    texts = [PROSE, PROSE, PROSE + " today", f"{PROSE}\nwrite to jane.doe@example.org or call 4539 1488 0343 6467", None, "", "  ", "too short", "a b c d e " * 8, f"{PROSE.upper()} 2020-02-03\n\n{PROSE}",
             " ".join(PROSE.split()[::-1]), "completely different words about ships that sail the northern seas in winter storms every single year"]
    return [(i, t, None if i == 3 else "en", "abc"[i % 3], len(t or ""), i, 7) for i, t in enumerate(texts)]


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    make(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (0, 1, 2, 3, 9, 10, 11)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def base_failed(text):
    w = words(text)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w) < 10 or 100 * len(repeated) > 20 * len(w)


def test_rules_stage(spark, rows, folder):
    docs = make(spark, rows)
    out = P.rules_stage(spark, docs, folder)
    kept = {tuple(r) for r in out.collect()}
    assert out.columns == docs.columns and kept <= set(rows)
    # what is trusted has a ratio near that of the corpus
    assert {r[0] for r in kept} == {r[0] for r in rows if not base_failed(r[1])} == {0, 1, 2, 3, 9, 10, 11}


def test_lines_stage(spark, rows, folder):
    docs, seen, want = make(spark, rows), [], {}
    for r in rows:
        kept = []
        for line in (r[1] or "").split("\n"):
            s = set(words(line))
            if s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                continue
            seen += [s] if s else []
            kept.append(line)
        want[r[0]] = None if r[1] is None else "\n".join(kept)
    out = P.lines_stage(spark, docs, folder)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)


def test_near_stage(spark, rows, folder):
    docs, kept = make(spark, rows), []
    for r in rows:
        w = words(r[1])
        bag = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()
        alike = lambda o, bag=bag: (not bag and not o) or (bag and o and 5 * sum((bag & o).values()) >= 4 * sum((bag | o).values()))
        if not any(alike(o) for _, o in kept):
            kept.append((r[0], bag))
    out = P.near_stage(spark, docs, folder)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [i for i, _ in kept]


def test_pii_stage(spark, rows, folder):
    out = P.pii_stage(spark, make(spark, rows), folder)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows) and all(r["pii_email"] == 7 for r in got.values())
    assert got[3]["text"] != rows[3][1] and "jane.doe" not in got[3]["text"] and "4539 1488 0343 6467" not in got[3]["text"]
    assert {i: r["text"] for i, r in got.items() if i not in (3, 9)} == {r[0]: r[1] for r in rows if r[0] not in (3, 9)}
    assert pii.rewrite(got[3]["text"], backwards=True)[0] == rows[3][1]


def packed_as(pieces, texts):
    """Pieces cover every document's ids, in sequences without gaps."""
    from tokenizers import Tokenizer

    known, spans = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), collections.defaultdict(list)
    for r in pieces:
        ids = [*known.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)) and len(ids) == r["length"]
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for sequence in spans.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at <= 2048
    total = collections.Counter()
    for r in pieces:
        total[r["doc_id"]] += r["length"]
    assert all(total[i] == len(known.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items())


def test_packing_stage(spark, rows, folder):
    packed_as(P.packing_stage(spark, make(spark, rows), folder).collect(), {r[0]: r[1] for r in rows})


def test_all_stages(spark, rows, folder):
    pieces = P.run(spark, folder).collect()
    # 1, 2 and 10 hold nothing but lines of 0 (10 the same words), and of texts without words one stays
    assert {r["doc_id"] for r in pieces} == {0, 1, 3, 9, 11}
    assert all(r["length"] == r["doc_tokens"] for r in pieces)


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES])
def test_empty_table(spark, folder, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0
