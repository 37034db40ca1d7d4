"""Whitening, shingle join and alignment against brute force, and cases that earlier versions got wrong."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("pitpanel.llm")

from pitpanel.llm import alignment, line_dedup, packing, pii, shingle_join, whitening  # noqa: E402
from pitpanel.llm.quality_rules import kept_documents, quality_rules  # noqa: E402
from pitpanel.llm.queries import vocabulary  # noqa: E402
from pitpanel.llm.token_counts import Table  # noqa: E402
from pitpanel.llm.words import WORDS, bytes_of, tokens  # noqa: E402


# --------------------------------------------------------------------------- whitening
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, at string, x string")


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, [float(c) for c in v], "x", None) for i, v in enumerate(base)]
    rows += [(100 + i, rows[0][1], "x", None) for i in range(30)]  # repeated vectors count once
    rows += [(None, rows[1][1], None, None), (200, None, "", ""), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], "", ""), (202, [float("nan")] * 6, "", ""), (203, [float("inf")] + [0.0] * 5, "", ""), (204, [1.0], "", ""), (205, [], "", "")]
    out = whitening.whiten(vectors(spark, rows).repartition(3)).collect()
    x = np.floor(256 * base.astype(np.float32).astype(np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True))
    want = ((x - s / n) @ u[:, ::-1][:, :4]) / np.sqrt(e[::-1][:4])
    got = defaultdict(dict)
    for r in out:
        got[r["vec_id"]][r["component"]] = r
    assert set(got) == {*range(60), *range(100, 130), None}
    z = np.array([[got[i][c]["whitened"] for c in (1, 2, 3, 4)] for i in range(60)])
    assert np.allclose(np.abs(z), np.abs(want), atol=1e-8)
    assert all(got[i][1]["deviation"] == int(((n * x[i] - s) ** 2).sum()) for i in range(60))
    assert all(r["n"] == n and r["identity_error"] < 1e-9 for r in out)
    assert np.allclose([got[0][c]["explained"] for c in (1, 2, 3, 4)], e[::-1][:4] / e.sum())
    assert [got[100][c]["whitened"] for c in (1, 2, 3, 4)] == pytest.approx([got[0][c]["whitened"] for c in (1, 2, 3, 4)])


@pytest.mark.parametrize("rows, count", [([], 0), ([(1, None, "", "")], 0), ([(1, [2.0, 3.0], "", "")], 2), ([(1, [2.0, 3.0], "", ""), (2, [2.0, 3.5], "", "")], 4)])
def test_whitening_without_variance(spark, rows, count):
    out = whitening.whiten(vectors(spark, rows)).collect()
    assert len(out) == count
    assert all(r["whitened"] is None for r in out if r["component"] == 2 or count == 2)


# --------------------------------------------------------------------------- shingle join
def brute_components(ids, texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= 90 * (len(a) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    low = defaultdict(list)
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)].append(d)
    return sorted(((d, len(s), min(low[root(i)], default=None) if s else d) for i, (d, s) in enumerate(zip(ids, sets, strict=True))), key=repr)


@pytest.mark.parametrize("cell, leaf", [(4096, 32), (3, 2)])
def test_shingle_components_equal_brute_force(spark, monkeypatch, cell, leaf):
    rnd = random.Random(cell)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", "  \n", "a", "A b", "a B", "a b c", "x " * 40]
    for _ in range(14):
        base = [rnd.choice(words) for _ in range(rnd.choice([8, 11, 12, 20, 40, 120]))]
        for _ in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                k = rnd.randrange(len(copy))
                copy[k : k + 1] = rnd.choice([[rnd.choice(words)], [rnd.choice(words)] * 2])
            texts.append(" ".join(copy))
    ids = [*range(len(texts))]
    rnd.shuffle(ids)
    ids[-1], ids[10] = None, ids[11]  # a null id, and one id on two rows
    texts[10] = texts[11]
    if cell < 10:  # all rounds, whatever they cost
        monkeypatch.setattr(shingle_join, "open_pairs", lambda left: 1 << 40)
    docs = spark.createDataFrame([(d, t, "n", 1) for d, t in zip(ids, texts, strict=True)], "doc_id long, text string, node string, sig int").repartition(3)
    got = sorted((tuple(r) for r in shingle_join.shingle_components(docs, cell=cell).collect()), key=repr)
    assert got == brute_components(ids, texts)


def test_long_variants_that_are_not_links_are_not_verified(spark, monkeypatch):
    """Long texts of one template, all less similar than a link: the numbers in groups let all pairs pass, parities none."""
    rnd = random.Random(5)
    base, texts = [f"w{i}" for i in range(2000)], []
    for v in range(12):
        copy = list(base)
        for k in rnd.sample(range(2000), 34):
            copy[k] = f"v{v}_{k}"
        texts.append(" ".join(copy))
    asked, made = [], shingle_join.verified
    monkeypatch.setattr(shingle_join, "verified", lambda pairs, *a: asked.append(pairs.count()) or made(pairs, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["component_id"] for r in shingle_join.shingle_components(docs).collect()) == list(range(12))
    assert asked and sum(asked) == 0


def test_trees_find_every_pair_that_bounds_allow():
    rng = np.random.default_rng(2)
    point = rng.poisson(3, size=(150, 8))
    found = {tuple(sorted(p)) for i, j, _ in shingle_join.RTree(point, 4).close_pairs(70, lambda i, j: i != j) for p in zip(i.tolist(), j.tolist(), strict=True)}
    size = point.sum(axis=1)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if 170 * np.minimum(point[i], point[j]).sum() >= 70 * (size[i] + size[j])}
    assert found == want and len(want) > 100


@pytest.mark.parametrize("rows", [10_000, 3])
def test_cells_of_the_same_sets_are_one(spark, rows):
    """Near copies share most bundles: their cells are one, also where batches cut some of them."""
    posts = [(sig, node) for sig in range(40) for node in (5, 6, 9)] + [(100, 5), (100, 6), (200, 7)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = shingle_join.shared_cells(spark.createDataFrame(posts, "sig long, node long").coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cells = defaultdict(set)
    for r in got:
        cells[r["sig"]].add(r["node"])
        assert r["lead"] == 5
    assert {frozenset(c) for c in cells.values()} == {frozenset({5, 6, 9}), frozenset({5, 6})}
    # the last cell of each task's batch keeps its own name
    assert rows < 10_000 or len(cells) <= 2 + 8


def test_only_sets_that_may_have_copies_are_shuffled(spark):
    texts = [" ".join(f"w{i}_{k}" for k in range(40)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0], texts[0], None])), "doc_id long, text string")
    signed = shingle_join.cut(shingle_join.sign(docs))
    nodes = shingle_join.cut(signed.filter("n > 0").groupBy("key").agg(shingle_join.F.min("doc_id").alias("node"), shingle_join.F.count("*").alias("copies")).withColumnRenamed("key", "of"))
    sketches = shingle_join.Sketches(signed, nodes)
    assert sketches.several.count() < 10  # the copied one, and few others by chance
    assert sorted(r["node"] for r in sketches.take("sigs").collect() if r["sigs"]) == list(range(200))
    assert "Exchange" not in sketches.take("sigs")._jdf.queryExecution().executedPlan().toString()


def test_points_of_any_size_are_packed():
    point = np.array([[0, 255, 3], [1, 256, 70_000], [0, 0, 0]], np.uint32)
    packed = shingle_join.packed_points(point)
    assert [len(p) for p in packed] == [4, 13, 4]
    assert shingle_join.unpacked_points(pa.array(packed, pa.binary())).tolist() == point.tolist()


def test_empty_table_of_the_shingle_join(spark):
    assert shingle_join.shingle_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --------------------------------------------------------------------------- alignment
A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, known = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.Pair(A, B)
    a.encode_special_tokens = True
    rows, links = [], []
    for t in texts:
        whole = (" " + (t or "")).encode()
        left, right = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        spelt = [[known.bytes_a[i] for i in left], [known.bytes_b[i] for i in right]]
        groups, own, i, j, pending, sizes = [], [], 0, 0, ([], []), [0, 0]
        if t and all(b"".join(s) == whole for s in spelt):
            ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
            while i < len(left):
                own.append((left[i], right[j]))
                step = (ends[0][i] <= ends[1][j], ends[1][j] <= ends[0][i])
                if step[0]:
                    pending[0].append(left[i])
                    i += 1
                if step[1]:
                    pending[1].append(right[j])
                    j += 1
                if all(step):
                    groups.append("|".join(",".join(map(str, p)) for p in pending))
                    pending = ([], [])
            sizes = [len(left), len(right)]
        links.append(own)
        rows.append((*sizes, len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = Counter(x for own in links for x in own)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(*r[:4], sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), r[4]) for r, own in zip(rows, links, strict=True)]


ODD = ["", None, " ", "\n", "a", " a", "a ", "a\n\nb", "a \n b", "x▁y", "<|endoftext|> hi <s>", "<0x41>", "é  é", "a\tb  c", "a b", "日本 語\n日本", "\x00a", "don't  stop", "x" * 5000, "a\r\nb", "ok ok", "ok ok"]


@pytest.mark.parametrize("work, frequent", [(alignment.PIECE_WORK, alignment.FREQUENT_PAIRS), (5, 7), (1, 0)])
def test_alignment_equals_a_plain_merge(spark, work, frequent):
    rnd = random.Random(work)
    parts = ["a", "b", " ", "\n", "\t", "é", " ", "z", "the ", " of", "'s", "1", "..", "日", "<|endoftext|>"]
    texts = ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, row int").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.alignment_counts(docs, A, B, frequent=frequent, work=work).collect()}
    assert [got[i] for i in range(len(texts))] == brute_alignment(texts)


def test_pieces_meet_at_any_border():
    rng = np.random.default_rng(1)
    for work in (1, 2, 3, 10):
        a, b = (np.append(np.sort(rng.choice(np.arange(1, 60), k, replace=False)), 60) for k in (20, 25))
        left, right, ends_a, ends_b = alignment.merged(a, b, work)
        every = np.unique(np.concatenate([a, b]))
        assert left.tolist() == np.searchsorted(a, every).tolist() and right.tolist() == np.searchsorted(b, every).tolist()
        assert a[ends_a].tolist() == b[ends_b].tolist() == np.intersect1d(a, b).tolist()


def test_empty_table_of_the_alignment(spark):
    assert alignment.alignment_counts(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


# --------------------------------------------------------------------------- cases that earlier versions got wrong
@pytest.mark.parametrize("texts", [[""], [None], ["a"], ["one two", "hi", ""], ["x" * 5_000_000, "y" * 100]])
def test_rules_without_any_window(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    none = spark.createDataFrame([], "doc_id long")
    assert [(r["n_repeat_words"], r["kept"]) for r in quality_rules(docs, none).collect()] == [(0, False)] * len(texts)
    assert kept_documents(docs, none).count() == 0


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [6, 10, 12])
def test_regular_words_have_different_hashes(n):
    a, b = thue_morse(n)
    data, offsets = bytes_of(pa.array([f"{a} {b}"]))
    assert len(set(tokens(data, offsets, WORDS).hash.tolist())) == 2
    path = vocabulary("word_bpe_49k.json")
    known = Table(path, ids=True)
    flat, marks = known.ids_of(*bytes_of(pa.array([a, b])))
    plain = [known.cutter.tokenizer.encode(t, add_special_tokens=False).ids for t in (a, b)]
    assert [flat[x:y].tolist() for x, y in zip(marks[:-1], marks[1:], strict=True)] == plain


@pytest.mark.parametrize("line", ["A" * 1_000_000 + " = 1", "a1" * 300_000 + "@", "x." * 200_000 + "@" + "y-" * 200_000, "token=" + "Zm9v" * 50_000, "a@b " * 50_000 + "1"])
def test_long_runs_take_linear_time(line):
    start = time.time()
    pii.rewrite(line)
    assert time.time() - start < 60


def test_addresses_behind_other_values_and_in_long_runs():
    new, finds = pii.rewrite("call +49 30 1234567 joe.x@example.com; " + "q" * 3000 + "@example.org and .@x.com 12.12.2020")
    assert [k for k, _, _ in finds].count("email") == 2 and "joe.x" not in new
    back, _ = pii.rewrite(new, backwards=True)
    assert back.startswith("call +49 30 1234567 joe.x@example.com; " + "q" * 3000)


@pytest.mark.parametrize("targets, temper", [(None, 1.0), (None, 0.5), ({"a": 0.5, "b": 0.3, "c": 0.2}, 1.0), ({"a": 0.7, "z": 0.3}, 0.7), ({"t": 1e-6, "b": 1.0}, 1.0)])
def test_schedule_is_gapless_and_keeps_its_targets(targets, temper):
    sizes = {"a": 5_000, "b": 70_001, "c": 1, "d": 333, "t": 2}
    plan = packing.Schedule(sizes, targets, 512, temper)
    seen = np.zeros(sum(sizes.values()), int)
    for q, n in sizes.items():
        at = 0
        while at < n:
            spot, room = plan.place_of(q, at)
            assert room > 0
            seen[spot : spot + room] += 1
            at += room
        assert at == n
    assert (seen == 1).all()


def test_schedule_of_very_many_tokens_is_small():
    sizes = {f"q{i}": 10**8 + i for i in range(6)}
    targets = {f"q{i}": w for i, w in enumerate((0.5, 0.3, 0.1, 0.06, 0.039, 0.001))}
    plan = packing.Schedule(sizes, targets)
    window = packing.WINDOW_SEQUENCES * packing.SEQUENCE
    spot, _ = plan.place_of("q1", 30_000_000)
    had = {q: plan._served(0, spot // window)[i] for i, q in enumerate(sizes)}
    assert len(plan.rounds) == 2 and all(abs(had[q] / spot - w) < 1e-2 for q, w in targets.items())


@pytest.mark.parametrize("most", [1, 8])
def test_lines_with_many_possible_partners(spark, monkeypatch, most):
    """Variants of a few passages, many close but not close enough: turn by turn, the same lines go as by comparing all."""
    rnd = random.Random(most)
    lines = []
    for _ in range(4):
        base = [f"w{rnd.randrange(400)}" for _ in range(12)]
        for _ in range(60):
            line = list(base)
            for _ in range(rnd.choice([1, 2, 3, 4])):
                line[rnd.randrange(12)] = f"v{rnd.randrange(40)}"
            lines.append(" ".join(line))
    made = line_dedup.next_pairs
    monkeypatch.setattr(line_dedup, "next_pairs", lambda posts, percent, _: made(posts, percent, most))
    docs = spark.createDataFrame([(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(80)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.removed_lines(docs).collect()}
    sets, want = [frozenset(x.split()) for x in lines], defaultdict(list)
    for i, s in enumerate(sets):
        if any(100 * len(s & o) >= 80 * len(s | o) for o in sets[:i]):
            want[i // 3].append(i % 3)
    assert got == {i: want[i] for i in range(80)}


def test_no_task_of_the_line_join_needs_two_python_workers(spark, monkeypatch):
    """What is asked for the next turn is read from the kept table, not from posts that another Python function makes in the same task."""
    asked, made = [], line_dedup.possible
    monkeypatch.setattr(line_dedup, "possible", lambda df, column, bits: asked.append((column, df._jdf.queryExecution().toString())) or made(df, column, bits))
    monkeypatch.setattr(line_dedup, "GATHERED", 64)  # pairs leave the loop over partners many times
    test_lines_with_many_possible_partners(spark, monkeypatch, 8)
    assert "word" in [c for c, _ in asked] and not any("MapInArrow" in plan for _, plan in asked)


def test_whole_documents_are_decoded(spark):
    from pitpanel.llm.piece_codec import round_trip

    texts = [None, "", "a b", " a  b ", "x▁y", "é\n日本 ok", "<s> <0x41> </s>", "word " * 30_000, "\x00 a"]
    rows = {r["doc_id"]: r for r in round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), B).collect()}
    assert [rows[i]["decoded_equal"] for i in range(len(texts))] == [t != "x▁y" for t in texts]
    assert all(r["n_differ"] == 0 for r in rows.values())


def test_memo_keeps_marks_of_two_generations():
    from pitpanel.llm.piece_codec import Memo

    memo = Memo(lambda words: [len(w) for w in words], 2)
    memo.marked.add("bad")
    for texts in ([["bad", "a", "b"]], [["c", "bad"]], [["d", "e", "f"]], [["g", "bad"]]):
        memo.need(texts)
        if "bad" in texts[0]:
            assert memo.marks(texts[0]) == 1
    assert len(memo.new) + len(memo.old) < 10


def test_two_attempts_write_the_same_archives(spark, tmp_path):
    from pitpanel.llm import warc

    pages = [(i % 40 if i % 7 else None, f"http://h/{i % 3}", f"<p>{i % 25}</p>" * 30) for i in range(120)]
    files = []
    for number, rows in enumerate((pages, pages[::-1])):
        records = warc.with_roles(spark.createDataFrame(rows, "page_id long, url string, html string")).coalesce(1)
        at = tmp_path / str(number)
        warc.write_archives(records, f"file://{at}", limit=5_000).collect()
        files.append({f.name: f.read_bytes() for f in at.iterdir()})
    assert files[0] == files[1] and len(files[0]) > 3


@pytest.mark.parametrize("ids", [[4, 3, 2, 1], [4, 3, 3, 1], [None, 3, None, 1], [None, (1 << 63) - 1, 2, 1]])
def test_texts_under_one_id_are_told_apart_only_where_there_are_some(spark, ids):
    texts = ["one two three four five\nz1 z2", "one two three four five\n\nz3 z4", "z5 z6\none two three four five", " \nz7\n"]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    rid = line_dedup.telling(docs)
    keys = {r[0] for r in docs.select(rid).collect()}
    assert (keys == {0}) == (ids == [4, 3, 2, 1])
    got = line_dedup.without_lines(docs).collect()
    assert len(got) == 4 and sum("one two three four five" in r["text"].split("\n") for r in got) == 1
    assert sum(r["n_removed"] for r in line_dedup.removed_lines(docs).collect()) == 2
    if ids == [4, 3, 2, 1]:
        assert {r["doc_id"]: r["removed_lines"] for r in line_dedup.removed_lines(docs).collect()} == {4: [0], 3: [0], 2: [], 1: []}


def test_lines_are_found_without_hashes(monkeypatch):
    from pitpanel.llm import words

    texts = ["", "\n\n", "a b\n\n \t\nc" + "d" * 50, "x", " \ny z\n"]
    data, offsets = bytes_of(pa.array(texts))
    monkeypatch.setattr(words, "span_hashes", None)  # neither lines nor, where they are only found, words are hashed
    owner, number, of = line_dedup.lines_at(data, offsets, words.spans(data, offsets, WORDS)[0])
    assert list(zip(owner.tolist(), number.tolist(), strict=True)) == [(i, k) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if line.split()]
    assert of.tolist() == [0, 0, 1, 2, 3, 3]


def test_posts_of_the_line_join_are_sorted_by_one_number(spark, monkeypatch):
    """A post is a key and one value, Spark sorts it by the key alone, and classes need no aggregate over lists."""
    seen, made = [], line_dedup.first_pairs
    monkeypatch.setattr(line_dedup, "first_pairs", lambda posts, percent: seen.append((posts, made(posts, percent))) or seen[-1][1])
    kept, tables = line_dedup.table, {}
    monkeypatch.setattr(line_dedup, "table", lambda df, name, **o: tables.setdefault(name, df) is None or kept(df, name, **o))
    test_lines_with_many_possible_partners(spark, monkeypatch, 8)
    posts, pairs = seen[0]
    assert [t for _, t in posts.dtypes] == ["bigint", "binary", "binary"]
    assert "Sort [key#" in (plan := pairs._jdf.queryExecution().executedPlan().toString()) and not any("key#" in x and ", at#" in x for x in plan.split("\n") if "Sort [" in x)
    assert "Aggregate" not in tables["classes"]._jdf.queryExecution().toString()


@pytest.mark.parametrize("ids", [[5, 6, 7], [0, 1 << 40, (1 << 63) - 1], [-(1 << 62), 3, 1 << 62]])
@pytest.mark.parametrize("rids", [[0], [-3, 0, 9]])
def test_posts_come_in_the_order_of_key_and_class(ids, rids):
    rnd = np.random.default_rng(1)
    post = np.zeros(400, line_dedup.POST)
    post["at"], post["rid"], post["line_no"] = rnd.choice(ids, 400), rnd.choice(rids, 400), rnd.integers(0, 9, 400)
    post["n"], post["x"], post["place"] = np.arange(400), -np.arange(400), np.arange(400) % 7
    key = np.sort(rnd.integers(-4, 4, 400))
    batch = pa.record_batch({"key": key, "post": line_dedup.runs(post, np.arange(1, 401))})
    got_key, place, at, rid, line_no, n, x, _, order = line_dedup.in_order(batch.slice(3))
    want = sorted(zip(key[3:].tolist(), post["at"][3:].tolist(), post["rid"][3:].tolist(), post["line_no"][3:].tolist(), strict=True))
    assert list(zip(got_key.tolist(), at.tolist(), rid.tolist(), line_no.tolist(), strict=True)) == want
    assert (x == -n).all() and (place == n % 7).all() and (order == n - 3).all()


def test_words_of_more_lines_than_are_sorted_at_once(monkeypatch):
    """Distinct words by line, rare ones first and in one order for all lines; lines are sorted a few at a time."""
    rnd = np.random.default_rng(2)
    frequency = line_dedup.Frequencies.__new__(line_dedup.Frequencies)
    frequency.rarity = rnd.integers(0, 128, line_dedup.COUNTERS).astype(np.uint64)
    vocabulary = rnd.integers(0, 1 << 64, 50, dtype=np.uint64)
    of = np.repeat(np.arange(10_000), rnd.integers(1, 6, 10_000))
    h = vocabulary[rnd.integers(0, 50, len(of))]
    lines, hashes = frequency.sets(of, h)
    rank = {int(v): (int(frequency.rarity[int(v) & (line_dedup.COUNTERS - 1)]), int(v) >> 19) for v in vocabulary}
    want = defaultdict(set)
    for i, v in zip(of.tolist(), h.tolist(), strict=True):
        want[i].add(v)
    assert list(zip(lines.tolist(), hashes.tolist(), strict=True)) == [(i, v) for i in range(10_000) for v in sorted(want[i], key=rank.get)]
    assert [len(v) for v in frequency.sets(of[:0], h[:0])] == [0, 0]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_first_lines_of_classes_across_batches(size):
    rnd = random.Random(size)
    rows = [(i is None, i, rnd.choice([0, 5]), rnd.randrange(3), k1, rnd.randrange(2)) for k1 in range(9) for i in (rnd.choice([None, 1, 2, (1 << 63) - 1]) for _ in range(rnd.randrange(1, 9)))]
    data = {c: [r[k] for r in rows] for k, c in enumerate(("no_id", "doc_id", "rid", "line_no", "k1", "k2"))}
    batch = pa.record_batch({c: pa.array(v, pa.bool_() if c == "no_id" else pa.int32() if c == "line_no" else pa.int64()) for c, v in data.items()})
    got = [tuple(r[c] for c in data) for b in line_dedup.first_lines(batch.slice(i, size) for i in range(0, len(rows), size)) for r in b.to_pylist()]
    best = {}
    for r in rows:
        order = (r[0], r[1] or 0, r[2], r[3])
        if (r[4], r[5]) not in best or order < best[r[4], r[5]][0]:
            best[r[4], r[5]] = (order, r)
    assert sorted(got, key=lambda r: r[4:]) == [best[k][1] for k in sorted(best)]
    assert not list(line_dedup.first_lines(iter([])))


def test_lines_with_words_are_found_without_the_words():
    texts = ["", "\n\n", "a b\n\n \t\nc", "x", " \ny z\n", "\n", " ", "é\n\x0b\n#"]
    data, offsets = bytes_of(pa.array(texts))
    n_lines, owner, number = line_dedup.worded_lines(data, offsets)
    assert n_lines.tolist() == [t.count("\n") + 1 for t in texts]
    assert list(zip(owner.tolist(), number.tolist(), strict=True)) == [(i, k) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if line.strip(" \t\n\x0b\x0c\r")]
    data, offsets = bytes_of(pa.array(["", ""]))
    assert [v.tolist() for v in line_dedup.worded_lines(data, offsets)] == [[1, 1], [], []]
