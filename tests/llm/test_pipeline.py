"""The five stages together, against brute force on made documents."""

import random
import re

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from packetloom.llm import packing  # noqa: E402

#: Clashing names on purpose: columns that the stages use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, version string, kept boolean, component string, _row long"


def prose(seed, n, vocabulary=600):
    r = random.Random(seed)
    return [f"{r.choice(('stone', 'river', 'cloud', 'apple', 'winter'))}{r.randrange(vocabulary)}" for _ in range(n)]


def made_documents():
    r, texts = random.Random(9), {}
    for i in range(60):
        texts[i] = " ".join(prose(i, r.randrange(40, 300)))
    for i in range(60, 90):  # toxic ones, and labelled ones of their kind
        ws = prose(i, 80)
        for k in range(0, 80, 8):
            ws[k] = ("vilescum", "vilescums", "hatefool", "hatefools")[(i + k) % 4]
        texts[i] = " ".join(ws)
    for i in range(90, 110):  # copies and near copies
        ws = texts[i % 5].split()
        for _ in range((i - 90) % 4):
            ws[r.randrange(len(ws))] = f"edit{r.randrange(1000)}"
        texts[i] = " ".join(ws).upper() if i % 3 == 0 else " ".join(ws)
    item = " ".join(f"question{k}" for k in range(14))
    texts[110] = texts[6] + " " + item + " more"
    texts[111] = texts[7].replace(" ", "\n") + ", " + item.title().replace(" ", ", ")
    texts[112] = "before short answer after " + " ".join(prose(112, 50))
    texts[113] = "short but no answer " + " ".join(prose(113, 50))
    texts[114] = "write to ann.lee@example.org or 10.1.2.3 or +1 (555) 010-9999 " + " ".join(prose(114, 40))
    texts[115] = "write to bob [at] example [dot] com please " + " ".join(prose(115, 40))
    texts |= {116: None, 117: "", 118: "  \n ", 119: "one", 120: "one", 121: " ".join(prose(121, 6000))}
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), "v", True, "c", i) for i, t in texts.items()]
    rows += [(None, "a text without an id " + " ".join(prose(500, 30)), "en", "s", None, "v", None, None, None), (None, None, None, None, None, None, None, None, None)]
    rows += [rows[3], (8, " ".join(prose(8_000, 50)), "en", "s", 1, "v", True, "c", 1)]  # a repeated row; a second text of one doc_id
    benchmark = [("q1", item), ("q2", "Short, answer"), ("q3", None), ("q4", ""), (None, "nobody")]
    labels = [(i, 1, 1) for i in range(60, 84)] + [(i, 1, 0) for i in range(0, 55)] + [(None, 1, 1), (2, None, None), (9_999, 0, 1)]
    return rows, benchmark, labels


def write_tables(spark, at, rows, benchmark, labels):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def lower(text):
    return (text or "").translate({65 + k: 97 + k for k in range(26)})


def brute_near(rows, n=5):
    """Rows that stay: by text, the components of links, of which the smallest doc_id's row stays."""
    first, sets = {}, {}
    for doc_id, text, *_ in rows:
        ws = tuple(re.findall(r"[^ \t-\r]+", lower(text)))
        if ws and doc_id is not None:
            first[ws] = min(first.get(ws, doc_id), doc_id)
            sets[ws] = {ws[i : i + n] for i in range(len(ws) - n + 1)} or {ws}
    parent = {i: i for i in first.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(first[a]), find(first[b])
                parent[max(x, y)] = min(x, y)
    return [r for r in rows if r[0] is None or not (ws := tuple(re.findall(r"[^ \t-\r]+", lower(r[1])))) or find(first[ws]) == r[0]]


def brute_clean(rows, benchmark):
    of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = set()
    for item, text in benchmark:
        ws = of(text)
        if item is not None and ws:
            n = min(10, len(ws))
            windows |= {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    sizes = {len(w) for w in windows}
    return [r for r in rows if not any(tuple(ws[i : i + n]) in windows for ws in [of(r[1])] for n in sizes for i in range(len(ws) - n + 1))]


def key(row):
    return tuple("" if x is None else str(x) for x in row)


def test_stages_agree_with_brute_force(spark, tmp_path):
    rows, benchmark, labels = made_documents()
    sf_dir = write_tables(spark, tmp_path, rows, benchmark, labels)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "pii", "packing"]
    plain = [r for r in rows if r[0] is None or not 60 <= r[0] < 90]
    wanted = [plain, brute_near(plain)]
    wanted.append(brute_clean(wanted[1], benchmark))
    masked = {
        114: rows[114][1].replace("ann.lee@example.org", "<EMAIL>").replace("10.1.2.3", "<IP>").replace("+1 (555) 010-9999", "<PHONE>"),
        115: rows[115][1].replace("bob [at] example [dot] com", "<EMAIL>"),
    }
    wanted.append([(r[0], t := masked.get(r[0], r[1]), *r[2:4], None if t is None else len(t), *r[5:]) for r in wanted[2]])
    assert {110, 111, 112} & {r[0] for r in wanted[1]} and not {110, 111, 112} & {r[0] for r in wanted[2]} and 113 in {r[0] for r in wanted[2]}
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], wanted):
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        assert sorted(map(key, kept.collect())) == sorted(map(key, want)), name
        kept.write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    tokenizer = packing._tokenizer(public_tokenizers.path(packing.VOCABULARY))
    lengths = sorted(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in wanted[3])
    by_document = {}
    for p in pieces:
        by_document.setdefault((p.doc_id, p.start - p.piece * 2048), []).append(p)
        assert p.start == 2048 * p.piece
    whole = sum(lengths)
    assert sum(p.length for p in pieces) == whole and len([p for p in pieces if p.piece == 0]) == len(wanted[3])
    for sequence in {p.sequence_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == sequence), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    # One more than what the ids need at least.
    assert len({p.sequence_id for p in pieces}) <= -(-whole // 2048) + 1


def test_empty_tables(spark, tmp_path):
    sf_dir = write_tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


def test_documents_stay_without_labels_and_benchmark(spark, tmp_path):
    rows = made_documents()[0][:30]
    sf_dir = write_tables(spark, tmp_path, rows, [], [])
    assert {p.doc_id for p in corpus_pipeline.run(spark, sf_dir).collect()} == {r[0] for r in brute_near(rows)}
