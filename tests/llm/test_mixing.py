from agrovane.llm import mixing


def fill(sizes, weights, epochs=3):
    """Round by round: share by weight, clamp what is above, share again."""
    budget, clamped = sum(sizes), set()
    while True:
        left = budget - sum(epochs * sizes[k] for k in clamped)
        weight = sum(w for k, w in enumerate(weights) if k not in clamped)
        above = {k for k in range(len(sizes)) if k not in clamped and left * weights[k] > epochs * sizes[k] * weight}
        if not above:
            return [float(epochs * s) if k in clamped else left * weights[k] / weight if weight else 0.0 for k, s in enumerate(sizes)]
        clamped |= above


def test_targets_against_rounds(spark):
    for sizes in ([5, 900, 10, 40, 1000, 3], [7], [0, 0, 4], [100, 1, 1, 1, 1, 1, 1], [0, 0]):
        weights = [k % 3 + 1 for k in range(len(sizes))]
        table = spark.createDataFrame([(f"s{k}", s, w) for k, (s, w) in enumerate(zip(sizes, weights, strict=True))], "source string, source_size long, weight long")
        got = [r["target"] for r in mixing.water_fill(table).orderBy("source").collect()]
        assert all(abs(a - b) <= 1e-9 * max(1, b) for a, b in zip(got, fill(sizes, weights), strict=True))


def test_weights_follow_code_points_with_null_last(spark):
    names = ["b", "a", "é", "Z", None, "aa", ""]
    table = spark.createDataFrame([(n, 1) for n in names], "source string, source_size long")
    got = {r["source"]: r["weight"] for r in mixing.cyclic_weights(table).collect()}
    ordered = sorted((n for n in names if n is not None), key=lambda n: n.encode()) + [None]
    assert got == {n: k % 3 + 1 for k, n in enumerate(ordered)}


def test_mix(frame, corpus, rows):
    out = mixing.op9(frame(corpus))
    got = out.collect()
    assert len(got) == len(corpus)
    assert rows(out) == rows(mixing.op9(frame(corpus[::-1])))
    taken, target, largest = {}, {}, {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    assert abs(sum(target.values()) - sum(r["size"] for r in got)) < 1e-6
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)


def test_empty_table_and_empty_texts(frame):
    assert mixing.op9(frame([])).collect() == []
    got = mixing.op9(frame([(1, None), (2, "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
