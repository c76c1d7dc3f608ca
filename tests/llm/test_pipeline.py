import re

import corpus_pipeline
from hearthwave.llm import decontaminate, pii, quality
from tests.llm.helpers import awkward, documents, empty
from tests.llm.test_copies import _first_of_each as first_of_each
from tests.llm.test_mixing import _targets as targets


def _tables(spark, path):
    rows, labels = [], []
    for i in range(240):
        if i % 4 == 0:
            text = "BUY NOW!! " * 30 + str(i)
        else:
            text = " ".join(f"topic{i}x{j} and river{(i * 31 + j * 7) % 997} by the" for j in range(40)) + f" mail a{i}@b.org."
        rows.append((i, text, f"s{i % 3}"))
        labels.append((i, int(i % 4 != 0), 0))
    rows += [(1000, rows[1][1], "s0"), (1001, rows[2][1] + " tail", "s1"), (1002, rows[3][1] + " " + "benchmark words that must never be seen in any training text at all today", "s2")]
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "benchmark words that must never be seen in any training text at all today")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def test_pipeline_against_plain_steps(spark, tmp_path):
    rows = _tables(spark, str(tmp_path))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {i for i, _, _ in rows if i < 1000 and i % 4}  # the copies 1000 and 1001 go; 1002 nearly repeats 3, which stays
    assert set(got) == want
    assert all(r["size"] == len(dict((i, t) for i, t, _ in rows)[i].split()) for i, r in got.items())
    assert abs(sum(r["taken"] for r in got.values()) - sum(r["size"] for r in got.values())) <= 3
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got.values())


def test_stages_keep_the_columns(spark, tmp_path):
    _tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, awkward(spark), str(tmp_path)).collect()
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-dedup", "decontamination", "pii", "mixing"]
    assert {quality, decontaminate, pii}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _plain_redacted(t):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(?:\.[0-9]+){3}", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(re.sub("[^0-9]", "", m)))) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
        ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", lambda m: int("".join(str(int(c, 36)) for c in m.replace(" ", "")[4:] + m.replace(" ", "")[:4])) % 97 == 1),
        ("secret", r"[0-9A-Za-z]{32,}", lambda m: re.fullmatch("[0-9A-Fa-f]{32,128}", m) and re.search("[0-9]", m) and re.search("[A-Fa-f]", m)),
    ]
    out, reach = "", 0
    near = re.compile(r"(?:^|[^a-z0-9])(?:token|secret|key|apikey|password|passwd|bearer|credential)(?:$|[^a-z0-9])")
    told = ((m.start(), m.end(), k) for k, p, ok in kinds for m in re.finditer(p, t) if ok(m[0]))
    kept = (x for x in told if x[2] != "secret" or near.search(t[max(0, x[0] - 40) : x[0]].lower()) or near.search(t[x[1] : x[1] + 40].lower()))
    for start, end, kind in sorted(kept):
        if start >= reach:
            out += t[reach:start] + f"[{kind.upper()}]"
        reach = max(reach, end)
    return out + t[reach:]


def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept of the given documents, against a plain version of it."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r["item_id"], _words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r for r in docs.collect()}

    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    good = stages["quality"](spark, docs, sf_dir)
    assert {r["doc_id"] for r in good.collect()} == {i for i, s in scores.items() if s >= 0.7} != set(rows)

    left = sorted((r["doc_id"], r["text"] or "") for r in good.collect())
    want = first_of_each(left)
    good = spark.createDataFrame(good.collect(), docs.schema)
    single = stages["near-dedup"](spark, good, sf_dir)
    assert {r["doc_id"] for r in single.collect()} == want and len(want) < len(left)

    windows = {tuple(w[i : i + min(10, len(w))]) for _, w in items for i in range(max(len(w) - 9, 1) if w else 0)}
    sizes = {len(w) for w in windows}
    clean = {i for i in want if not any(tuple(w[j : j + n]) in windows for w in [_words(rows[i]["text"])] for n in sizes for j in range(len(w) - n + 1))}
    single = spark.createDataFrame(single.collect(), docs.schema)
    unseen = stages["decontamination"](spark, single, sf_dir)
    assert {r["doc_id"] for r in unseen.collect()} == clean != want

    unseen = spark.createDataFrame(unseen.collect(), docs.schema)
    private = {r["doc_id"]: r["text"] for r in stages["pii"](spark, unseen, sf_dir).collect()}
    assert private == {i: _plain_redacted(rows[i]["text"] or "") if rows[i]["text"] is not None else None for i in clean} and any("[EMAIL]" in (t or "") for t in private.values())

    plain = [(i, t, rows[i]["source"]) for i, t in private.items()]
    mixed = stages["mixing"](spark, documents(spark, plain), sf_dir).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in plain}
    by_source = {s: sum(size[i] for i, _, x in plain if x == s) for s in {s for _, _, s in plain}}
    due = targets(by_source)
    assert {r["doc_id"]: r["size"] for r in mixed} == size and all(r["taken"] <= 3 * r["size"] for r in mixed)
    assert all(abs(sum(r["taken"] for r in mixed if rows[r["doc_id"]]["source"] == s) - due[s]) <= 1 for s in by_source)
