from tests.llm.test_splitting import run


def test_near_ends_are_in_reach(spark):
    # The middles lie 111 apart, the near ends 91, and a piece may add 90 or 95 to the one before.
    gaps = [("x", 40, 60), ("x", 151, 171)]
    for overlap, forced in ((5, 0), (10, 1)):
        ends = [b for _, _, b in run(spark, [("x", 230)], gaps, limit=100, overlap=overlap)["x"]][:-1]
        assert sum(not any(a <= e <= b for _, a, b in gaps) for e in ends) == forced
