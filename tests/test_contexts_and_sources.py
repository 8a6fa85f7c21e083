"""Document units, contexts without exercises, widened contexts and written files, by cases and plain Python."""

import random

from lexmill.functions.folds import sentence_list
from lexmill.operators import cleaning, widening
from lexmill.sources import files


def test_document_units():
    paras = ["Chapter 1 Start", "a" * 590, "2.1 A heading that is long", "b" * 3480, "c" * 200, "d. " * 3000]
    units = cleaning.split_document("\n\n".join(paras))
    assert [u for _, u, _ in units[:3]] == ["\n\n".join(paras[:2]), "\n\n".join(paras[2:4]), paras[4]]
    assert [h for _, _, h in units[:3]] == ["Chapter 1 Start", "2.1 A heading that is long", ""]
    long = [u for _, u, _ in units[3:]]
    assert " ".join(long) == " ".join(sentence_list(paras[5])) and len(long) == 2 and max(map(len, long)) <= cleaning.MOST
    assert cleaning.split_document("") == [] and cleaning.split_document(" \n \n") == []
    words = " ".join(f"Word{k}." for k in range(20_000))
    assert " ".join(u for _, u, _ in cleaning.split_document(words)) == words


RAW = (
    "Summary: Cau 21: Mot quan the vi khuan ban dau gom 500 vi khuan. Toc do tang truong duoc cho boi P'(t)=k t. Sau 1 ngay co 600 vi khuan. "
    "Hoi sau 9 ngay co bao nhieu vi khuan? Loi giai: Ap dung cong thuc nguyen ham de tinh P(t). Cau 22: Mot dan con trung co K'(t)=t+2. Hoi sau 10 ngay co bao nhieu con?"
)


def test_contexts_lose_their_exercises(spark):
    rows = [
        (1, RAW),
        (2, "Định nghĩa: đạo hàm là giới hạn."),
        (3, None),
        (4, "Chọn đáp án.\nA. 1\nB. 2\nC. 3\nD. 4\nCông thức S = a h."),
        (5, "Xem A. 1 B. 2 C. 3 D. 4 xong"),
        (6, "Ví dụ: hai số."),
        (7, "Bài 3. Tính tổng của mười số hạng đầu tiên trong dãy đã cho.\n\nTổng của mười số hạng đầu tiên trong dãy.\n\nTa có S = n(n+1)/2." + " Thêm chữ." * 12),
    ]
    got = {r["context_id"]: r for r in cleaning.clean_contexts(spark.createDataFrame(rows, "context_id long, text string")).collect()}
    one = " ".join(got[1]["clean"])
    assert got[1]["kind"] == "exercise" and len(got[1]["spans"]) == 2 and "Cau 21" not in one and "Hoi sau 9 ngay" not in one
    assert got[2]["kind"] == "theory" and got[2]["clean"] == ["Định nghĩa: đạo hàm là giới hạn."] and got[2]["spans"] == []
    assert got[3]["clean"] == [] and got[3]["kind"] == "theory"
    assert got[4]["kind"] == "exercise" and got[4]["clean"] == ["Công thức S = a h."]
    assert got[5]["kind"] == "exercise" and "A. 1" not in " ".join(got[5]["clean"])
    assert got[6]["kind"] == "example"
    assert got[7]["kind"] == "exercise" and "Ta có S = n(n+1)/2." in got[7]["clean"] and not any("mười số hạng" in s for s in got[7]["clean"])


def plain_context(slot, units, topics):
    own = sorted((u for u in units if u["source"] == slot["source"]), key=lambda u: u["doc_id"])
    at = {u["doc_id"]: k for k, u in enumerate(own)}
    like = lambda u: u["kind"] == "theory" or u["kind"] == "example" and slot["applied"]
    words = topics[slot["topic"]]

    def score(u):
        return 100 * len(words & set(u["text"].split())) - len(words) * (0 if like(u) else {"example": 8, "exercise": 35}.get(u["kind"], 15))

    def best(without):
        left = [u for u in own if u["doc_id"] not in without and score(u) >= 5 * len(words)]
        return max(left, key=lambda u: (score(u), -u["doc_id"]), default=None)

    me = at.get(slot["doc_id"])
    reach = min(max(slot["attempt"], 1), 3)
    found = [] if me is None else [own[me + off] for off in widening.OFFSETS[reach] if 0 <= me + off < len(own)]
    if reach == 1 and found and found[0]["kind"] == "exercise" and (b := best({slot["doc_id"]})) and b["kind"] != "exercise":
        found = [b]
    if reach == 3 and (b := best({u["doc_id"] for u in found})):
        found = [*found, b]
    usable = [u for u in found if not u["reason"]]
    if reach > 1:
        usable = [u for u in usable if like(u)] or [u for u in usable if u["kind"] != "exercise"] or usable
    if usable:
        return widening.ACTIONS[reach], [u["doc_id"] for u in usable]
    return (own[me]["reason"] if me is not None and own[me]["reason"] else "context_missing"), [u["doc_id"] for u in found]


def test_contexts_widen(spark):
    rng = random.Random(5)
    words = [f"word{k}" for k in range(12)]
    topics = {t: set(rng.sample(words, 4)) for t in range(3)}
    units = [{"source": s, "doc_id": 100 * n + 3 * k, "kind": rng.choice(["theory", "example", "exercise", "exercise", "summary"]), "reason": rng.choice(["", "", "", "context_too_noisy"]), "text": " ".join(rng.choices(words, k=rng.randint(0, 5)))} for n, s in enumerate("ab") for k in range(14)]
    slots = [{"slot_id": k, "source": u["source"], "doc_id": u["doc_id"], "attempt": rng.randint(0, 5), "topic": rng.randrange(3), "applied": rng.random() < 0.5} for k, u in enumerate(units * 4)]
    frame = lambda rows, schema: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = widening.contexts_of(frame(slots, "slot_id long, source string, doc_id long, attempt int, topic long, applied boolean"), frame(units, "source string, doc_id long, kind string, reason string, text string"), spark.createDataFrame([(t, sorted(w)) for t, w in topics.items()], "topic long, words array<string>"))
    assert {r["slot_id"]: (r["action"], r["doc_ids"]) for r in got.collect()} == {s["slot_id"]: plain_context(s, units, topics) for s in slots}


def test_corrupt_results_are_left_out(spark, tmp_path):
    for name, text in {"a": '{"metadata": {"job_id": "j", "cost": {"tokens": 3}}, "questions": [{"q": "1"}]}', "b": '{"metadata": {"job_id"', "c": "{}", "d": ""}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = files.results(spark, str(tmp_path))
    assert got.count() == 1 and got.first()["metadata"]["cost"]["tokens"] == 3 and got.first()["rejected"] is None
    path = files.written(spark.createDataFrame([("x", "---\nname: n\n---\nbody\n"), ("y", "plain")], "file string, text string"), "file", "text")
    assert sorted(r["body"] for r in files.instructions(spark, path).collect()) == ["body", "plain"]


def plain_trim(text, words, limit=200):
    from lexmill.operators.quotes import split_units

    text = text.strip()
    if len(text) <= limit:
        return text
    units = [u for _, u in split_units(text)]

    def points(u):
        digits, operators = sum(c.isdigit() for c in u), sum(c in "=<>^" for c in u)
        return 20 * len(words & set(u.lower().replace(".", " ").split())) + 12 * ("formula" in u.lower()) + min(16, 4 * operators) + min(8, digits) + (2 if 60 <= len(u) <= 420 else 0)

    kept, used = [], 0
    for order in (sorted(range(len(units)), key=lambda k: (-points(units[k]), k)), range(len(units))):
        if order == range(len(units)) and used >= 0.45 * limit:
            break
        for k in order:
            extra = len(units[k]) + (2 if kept else 0)
            wanted = order == range(len(units)) or points(units[k]) > 0 or not kept
            if used < 0.85 * limit and used + extra <= limit and k not in kept and wanted:
                kept.append(k)
                used += extra
    return "\n\n".join(units[k] for k in sorted(kept)) if kept else text[:limit].rstrip()


def test_trimmed_texts(spark):
    from lexmill.operators import trimming

    rng = random.Random(9)
    words = {0: {"alpha", "beta"}, 1: {"gamma"}}
    rows = [(1, 0, "short"), (2, 1, "x" * 900), (3, 0, ""), (4, 5, "y. " * 300)]
    for k in range(40):
        paras = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "formula", "12", "x = 3", "plain words here"], k=rng.randint(1, 12))) + "." for _ in range(rng.randint(1, 9))]
        rows.append((10 + k, k % 3, "\n\n".join(paras)))
    docs = spark.createDataFrame([*rows, (99, 0, None)], "doc_id long, topic long, text string")
    got = trimming.trimmed_texts(docs, spark.createDataFrame([(t, sorted(w)) for t, w in words.items()], "topic long, words array<string>"), 200)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {**{i: plain_trim(t, words.get(k, set())) for i, k, t in rows}, 99: ""}


def test_files_of_one_folder(spark):
    """Each row is a file of its own, and none needs a folder of its own."""
    path = files.written_alike(spark.createDataFrame([(f"text {k}\nline",) for k in range(25)], "text string"), "text")
    found = spark.read.text(path, wholetext=True).selectExpr("value", "_metadata.file_path AS path").filter("value != ''").collect()
    assert sorted(r["value"].strip() for r in found) == sorted(f"text {k}\nline" for k in range(25))
    assert len({r["path"] for r in found}) == 25 and len({r["path"].rsplit("/", 1)[0] for r in found}) == 1
