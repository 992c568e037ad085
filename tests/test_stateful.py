import pandas as pd

from haze.streaming.stateful import LastRows


class Kept:
    """A list state that is kept between batches."""

    def __init__(self):
        self.rows = []

    def getListState(self, name, schema):
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows


def batch(processor, *parts):
    columns = ["micros", "pm10"]
    out = pd.concat(processor.handleInputRows(("c",), iter(pd.DataFrame(p, columns=columns) for p in parts), None))
    return [tuple(None if pd.isna(v) else v for v in r) for r in out[["micros", "pm10", "_hist", "_late"]].itertuples(index=False)]


def test_state_keeps_the_last_rows_in_any_order():
    state, processor = Kept(), LastRows(3, "micros bigint, pm10 double", ["micros", "pm10"])
    processor.init(state)
    assert batch(processor, [(5, 1.0), (1, 1.0)], [(3, None), (2, 2.0)]) == [
        (5, 1.0, False, False), (1, 1.0, False, False), (3, None, False, False), (2, 2.0, False, False)]
    assert state.rows == [(2, 2.0), (3, None), (5, 1.0)]
    # 5 has come again, with another value; 4 and 1 are older than the state's newest; 6 is new, twice
    assert batch(processor, [(5, 9.0), (4, 4.0), (1, 1.0), (6, 7.0), (6, 6.0)]) == [
        (2, 2.0, True, False), (3, None, True, False), (5, 1.0, True, False),
        (4, 4.0, False, True), (1, 1.0, False, True), (6, 7.0, False, False), (6, 6.0, False, False)]
    assert state.rows == [(4, 4.0), (5, 1.0), (6, 6.0)]


def test_rows_that_come_again_change_nothing():
    state, processor = Kept(), LastRows(3, "micros bigint, pm10 double", ["micros", "pm10"])
    processor.init(state)
    batch(processor, [(1, 1.0), (2, 2.0)])
    before = list(state.rows)
    assert [r[2] for r in batch(processor, [(1, 1.0), (2, 2.0)])] == [True, True]
    assert state.rows == before
