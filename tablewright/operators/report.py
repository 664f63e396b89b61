"""Table profiles: as a frame, a dict, JSON, Markdown or HTML."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.config import get_config
from tablewright.functions.primitives import is_sorted, total_seconds
from tablewright.operators.associations import column_associations
from tablewright.stats import Quantiles, distinct_counts, profile
from tablewright.types import classify, is_numeric, missing, no_nan, quoted

ASSOCIATION_SAMPLE, HIGH_ASSOCIATION = 3000, 0.9
PROFILE = (
    "position int, column_name string, dtype string, n_rows long, n_nulls long, n_unique long, mean double, std double, min double, q25 double, median double, q75 double, max double"
)


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, dtype, nulls, distinct values, moments and quartiles.

    One job for counts and moments, one for distinct values, two or three for
    all quartiles; the result is as small as the table is wide.
    """
    fields = list(df.schema)
    asked: dict[str, Column | Quantiles] = {"n": F.count(F.lit(1))}
    for j, f in enumerate(fields):
        asked[f"{j} nulls"] = F.count(F.when(missing(f), 1))
        if is_numeric(f):
            x = no_nan(f).cast("double")
            asked |= {f"{j} mean": F.avg(x), f"{j} std": F.stddev_samp(x), f"{j} min": F.min(x), f"{j} max": F.max(x), f"{j} q": Quantiles(x, (0.25, 0.5, 0.75))}
    found = profile(df, asked)
    distinct = distinct_counts(df, {f"{j}": F.to_json(no_nan(f)) if classify(f) == "nested" else no_nan(f) + 0 if is_numeric(f) else no_nan(f) for j, f in enumerate(fields)})
    rows = []
    for j, f in enumerate(fields):
        q = found.get(f"{j} q") or [None] * 3
        spread = [found.get(f"{j} {k}") for k in ("mean", "std", "min")]
        rows.append((j, f.name, f.dataType.simpleString(), found["n"], found[f"{j} nulls"], distinct[f"{j}"], *spread, *q, found.get(f"{j} max")))
    return df.sparkSession.createDataFrame(rows, PROFILE)


def _as_number(field) -> Column:
    return total_seconds(field) if classify(field) in ("date", "duration") else no_nan(field).cast("double")


def robust_histograms(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """``(column, bin, low, high, n)`` over each column's inliers, outliers as bins -1 and ``bins``.

    Inliers lie within three times the 20-to-80 percentile range around it; where
    that hardly cuts anything (15 percent of the range), all values are inliers.
    All columns share the same few jobs.
    """
    x = {c: _as_number(df.schema[c]) for c in columns}
    finite = {c: F.when(F.abs(v) < float("inf"), v) for c, v in x.items()}
    asked = {(c, k): e for c, v in finite.items() for k, e in (("q", Quantiles(v, (0.2, 0.8))), ("min", F.min(v)), ("max", F.max(v)))}
    s = profile(df, asked)
    edges, cells = [], []
    for j, c in enumerate(columns):
        if s[c, "min"] is None:
            continue
        (q20, q80), low, high = s[c, "q"], s[c, "min"], s[c, "max"]
        margin, slack = 3 * (q80 - q20), 0.15 * (high - low)
        if q20 - margin - low > slack:
            low = q20 - margin
        if high - q80 - margin > slack:
            high = q80 + margin
        width = (high - low) / bins or 1.0
        place = F.when(finite[c] < low, -1).when(finite[c] > high, bins).otherwise(F.least(F.floor((finite[c] - low) / width), F.lit(bins - 1))).cast("int")
        cells.append(F.when(finite[c].isNotNull(), F.struct(F.lit(j).alias("j"), place.alias("bin"))))
        edges.append((j, c, float(low), float(width)))
    schema = "column string, bin int, low double, high double, n long"
    if not cells:
        return df.sparkSession.createDataFrame([], schema)
    counts = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.j", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    named = df.sparkSession.createDataFrame(edges, "j int, column string, start double, width double")
    out = counts.join(F.broadcast(named), "j")  # a row a column
    return out.select("column", "bin", (F.col("start") + F.col("bin") * F.col("width")).alias("low"), (F.col("start") + (F.col("bin") + 1) * F.col("width")).alias("high"), "n")


def robust_histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """``(bin, low, high, n)`` of one column, see :func:`robust_histograms`."""
    return robust_histograms(df, [column], bins).drop("column").orderBy("bin")


def duration_unit(seconds: float | None) -> str:
    """The unit in which a duration of this 90th percentile reads best."""
    for unit, size in (("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1), ("millisecond", 1e-3)):
        if seconds is not None and abs(seconds) >= size:
            return unit
    return "microsecond"


def column_filters(columns: list[dict]) -> dict[str, list[str]]:
    """Names of the columns that each of a report's filters shows."""
    def pick(test) -> list[str]:
        return [c["column_name"] for c in columns if test(c)]

    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return {
        "all": pick(lambda c: True),
        "has_nulls": pick(lambda c: c["n_nulls"]),
        "no_nulls": pick(lambda c: not c["n_nulls"]),
        "constant": pick(lambda c: c["is_constant"]),
        "all_unique": pick(lambda c: c["n_unique"] == c["n_rows"] > 0),
        "numeric": pick(lambda c: c["dtype"].startswith(numeric)),
        "text": pick(lambda c: c["dtype"] == "string"),
        "datetime": pick(lambda c: c["dtype"].startswith(("date", "timestamp"))),
    }


class TableReport:
    """A profile of a table; jobs run when a form is first asked for.

    Rows have no order in Spark: head, tail and the columns' order flags need
    ``order_by``; without it the sample is any rows.  Histograms are made for at
    most ``max_plot_columns`` numeric and time columns and associations for at
    most ``max_association_columns``, see :mod:`tablewright.config`.
    """

    def __init__(
        self, df: DataFrame, n_rows: int = 10, order_by: str | None = None, title: str | None = None, compute_associations: bool = True, top: int = 10,
        max_plot_columns: int | None = None, max_association_columns: int | None = None, verbose: int | None = None,
    ):
        settings = get_config()
        self.df, self.n_rows, self.order_by, self.title, self.associations, self.top = df, n_rows, order_by, title, compute_associations, top
        self.max_plots = settings["max_plot_columns"] if max_plot_columns is None else max_plot_columns
        self.max_associations = settings["max_association_columns"] if max_association_columns is None else max_association_columns
        self.verbose = settings["table_report_verbosity"] if verbose is None else verbose
        self._dict = None

    def dict(self) -> dict:
        if self._dict is not None:
            return self._dict
        df = self.df
        if self.verbose > 1:
            print(f"profiling {len(df.columns)} columns")
        columns = [r.asDict() for r in column_profile(df).orderBy("position").collect()]
        texts = [f for f in df.schema if classify(f) in ("string", "category", "bool")]
        if texts:
            pair = F.explode(F.array(*[F.struct(F.lit(f.name).alias("c"), quoted(f.name).cast("string").alias("value")) for f in texts]))
            counts = df.select(pair.alias("p")).select("p.*").where("value is not null").groupBy("c", "value").agg(F.count(F.lit(1)).alias("n"))
            order = (F.desc("n"), "value")
            part = counts.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(64)))
            leaders = part.withColumn("rank", F.row_number().over(Window.partitionBy("c", "part").orderBy(*order))).where(F.col("rank") <= self.top)
            top = leaders.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy(*order))).where(F.col("rank") <= self.top).orderBy("c", "rank").collect()
            for c in columns:
                if values := [[r["value"], r["n"]] for r in top if r["c"] == c["column_name"]]:
                    c["value_counts"] = values
        drawn = [f for f in df.schema if is_numeric(f) or classify(f) in ("date", "duration")][: self.max_plots]
        if drawn:
            bars = robust_histograms(df, [f.name for f in drawn]).orderBy("column", "bin").collect()
            for c in columns:
                if own := [[r["low"], r["high"], r["n"]] for r in bars if r["column"] == c["column_name"]]:
                    c["histogram"] = own
            for f in drawn:
                if classify(f) == "duration":
                    longest = profile(df, {"q": Quantiles(F.abs(_as_number(f)), (0.9,))})["q"]
                    columns[df.columns.index(f.name)]["duration_unit"] = duration_unit(longest[0] if longest else None)
        for c, f in zip(columns, df.schema, strict=True):
            share = c["n_nulls"] / c["n_rows"] if c["n_rows"] else 0.0
            c["null_proportion"] = share
            c["nulls_level"] = "ok" if share == 0 else "warning" if share < 1 else "critical"
            c["is_constant"] = c["n_unique"] == 1 and c["n_nulls"] == 0
            if self.order_by and f.name != self.order_by and (is_numeric(f) or classify(f) == "date"):
                c["is_ordered"] = is_sorted(df, f.name, [self.order_by])
        out = {"title": self.title, "n_rows": columns[0]["n_rows"] if columns else df.count(), "n_columns": len(columns), "columns": columns, "filters": column_filters(columns)}
        first = df.orderBy(quoted(self.order_by)) if self.order_by else df
        out["head"] = [r.asDict(recursive=True) for r in first.limit(self.n_rows).collect()]
        if self.order_by:
            last = df.orderBy(F.desc(quoted(self.order_by))).limit(self.n_rows).collect()
            out["tail"] = [r.asDict(recursive=True) for r in reversed(last)]
        if self.associations and 1 < len(columns) <= self.max_associations:
            rows = column_associations(df.limit(ASSOCIATION_SAMPLE)).limit(1000).collect()
            out["associations"] = [r.asDict() for r in rows]
            out["high_associations"] = [[r["left_column_name"], r["right_column_name"]] for r in rows if r["cramer_v"] > HIGH_ASSOCIATION]
        self._dict = out
        return out

    def json(self) -> str:
        return json.dumps(self.dict(), default=str)

    @staticmethod
    def _shown(value) -> str:
        return "" if value is None else f"{value:.{get_config()['float_precision'] + 1}g}" if isinstance(value, float) else str(value)

    def _tables(self) -> list[tuple[str, list[str], list[list]]]:
        """Title, header and rows of each table of the report."""
        out, keys = self.dict(), ("column_name", "dtype", "n_nulls", "n_unique", "mean", "std", "min", "median", "max")
        tables = [("Columns", list(keys), [[c[k] for k in keys] for c in out["columns"]])]
        for title in ("head", "tail"):
            if out.get(title):
                tables.append((title.capitalize(), list(out[title][0]), [list(r.values()) for r in out[title]]))
        tables += [(f"Values of {c['column_name']}", ["value", "count"], c["value_counts"]) for c in out["columns"] if "value_counts" in c]
        if out.get("associations"):
            tables.append(("Associations", list(out["associations"][0]), [list(a.values()) for a in out["associations"]]))
        return tables

    def markdown(self) -> str:
        parts = [f"# {self.title or 'Table'}", f"{self.dict()['n_rows']} rows"]
        for title, header, rows in self._tables():
            lines = [f"## {title}", "", "| " + " | ".join(header) + " |", "|" + "---|" * len(header)]
            parts.append("\n".join(lines + ["| " + " | ".join(self._shown(v).replace("|", "\\|").replace("\n", " ") for v in row) + " |" for row in rows]))
        return "\n\n".join(parts) + "\n"

    def html_snippet(self) -> str:
        body = [f"<h1>{html.escape(self.title or 'Table')}</h1><p>{self.dict()['n_rows']} rows, {self.dict()['n_columns']} columns</p>"]
        lists = "".join(f"<li>{html.escape(k)}: {html.escape(', '.join(v))}</li>" for k, v in self.dict()["filters"].items())
        body.append(f"<ul class='filters'>{lists}</ul>")
        for title, header, rows in self._tables():
            head = "".join(f"<th>{html.escape(h)}</th>" for h in header)
            lines = "".join("<tr>" + "".join(f"<td>{html.escape(self._shown(v))}</td>" for v in row) + "</tr>" for row in rows)
            body.append(f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{lines}</table>")
        for c in self.dict()["columns"]:
            if "histogram" in c:
                most = max(n for _, _, n in c["histogram"])
                bars = "".join(f"<rect x='{12 * j}' y='{60 - 60 * n / most:.1f}' width='11' height='{60 * n / most:.1f}'><title>{self._shown(low)} to {self._shown(high)}: {n}</title></rect>" for j, (low, high, n) in enumerate(c["histogram"]))
                body.append(f"<h2>{html.escape(c['column_name'])}</h2><svg width='{12 * len(c['histogram'])}' height='60'>{bars}</svg>")
        return "".join(body)

    def html(self) -> str:
        return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(self.title or 'Table')}</title></head><body>{self.html_snippet()}</body></html>"

    def write_html(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.html())
