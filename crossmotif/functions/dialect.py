"""The few expressions that Spark SQL and other engines spell differently.

Operators in ``crossmotif.operators`` are written once as relational text over named
relations; a dialect renders the expressions in which engines differ, so the same
definition runs as a Spark plan and as its reference query elsewhere.
"""

from __future__ import annotations


class SparkDialect:
    name = "spark"

    def array(self, *x: str) -> str:
        return f"array({', '.join(x)})"

    def set_text(self, arr: str) -> str:
        return f"array_join(array_sort(array_distinct({arr})), ',')"

    def set_of(self, *x: str) -> str:
        return self.set_text(self.array(*x))

    def agg_set(self, x: str) -> str:
        return f"array_join(array_sort(collect_set({x})), ',')"

    def agg_list(self, x: str, order: str) -> str:
        return f"transform(array_sort(collect_list(struct({order}, {x}))), v -> v.{x.split('.')[-1]})"

    def size(self, arr: str) -> str:
        return f"size({arr})"

    def has(self, arr: str, x: str) -> str:
        return f"array_contains({arr}, {x})"

    def append(self, arr: str, x: str) -> str:
        return f"concat({arr}, array({x}))"

    def hash48(self, x: str) -> str:
        return f"cast(conv(substr(md5({x}), 1, 12), 16, 10) as bigint)"

    def split_text(self, x: str) -> str:
        return f"split({x}, ',')"

    def unnest(self, relation: str, arr: str, alias: str) -> str:
        return f"{relation} LATERAL VIEW explode({arr}) exploded_{alias} AS {alias}"

    def median(self, x: str) -> str:
        return f"percentile({x}, 0.5)"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), cast(0 as double), (s, v) -> s + v)"

    def whole(self, a: str, b: str) -> str:
        """Integer quotient of numbers that are not negative."""
        return f"(({a}) div ({b}))"

    def hour(self, ts: str) -> str:
        return f"hour({ts})"

    def days(self, ts: str) -> str:
        return f"datediff({ts}, date'1970-01-01')"

    def day_text(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd')"

    def ranked(self, rows: str, order: str, alias: str) -> str:
        """Query of ``rows`` with their place 1, 2, ... in a total order. The runner places them by ranges."""
        return f"\u27e6{alias}\u00a6{order}\u00a6{rows}\u27e7"


class DuckDialect(SparkDialect):
    name = "duckdb"

    def array(self, *x: str) -> str:
        return f"[{', '.join(x)}]"

    def set_text(self, arr: str) -> str:
        return f"array_to_string(list_sort(list_distinct({arr})), ',')"

    def agg_set(self, x: str) -> str:
        return f"array_to_string(list_sort(list(DISTINCT {x})), ',')"

    def agg_list(self, x: str, order: str) -> str:
        return f"list({x} ORDER BY {order})"

    def size(self, arr: str) -> str:
        return f"len({arr})"

    def has(self, arr: str, x: str) -> str:
        return f"list_contains({arr}, {x})"

    def append(self, arr: str, x: str) -> str:
        return f"list_append({arr}, {x})"

    def hash48(self, x: str) -> str:
        return f"CAST('0x' || substr(md5({x}), 1, 12) AS BIGINT)"

    def split_text(self, x: str) -> str:
        return f"string_split({x}, ',')"

    def unnest(self, relation: str, arr: str, alias: str) -> str:
        return f"{relation}, unnest({arr}) AS exploded_{alias}({alias})"

    def median(self, x: str) -> str:
        return f"median({x})"

    def dot(self, a: str, b: str) -> str:
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"

    def whole(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def hour(self, ts: str) -> str:
        return f"hour({ts})"

    def days(self, ts: str) -> str:
        return f"date_diff('day', DATE '1970-01-01', CAST({ts} AS DATE))"

    def day_text(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m-%d')"

    def ranked(self, rows: str, order: str, alias: str) -> str:
        return f"SELECT placed_.*, row_number() OVER (ORDER BY {order}) AS {alias} FROM ({rows}) placed_"


SPARK, DUCK = SparkDialect(), DuckDialect()
