"""SQL building blocks for the oracles: named subqueries and what each of them needs."""

from __future__ import annotations

_LINE_ORDER = (
    "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, "
    "l_linestatus, l_shipdate"
)
_SCORE = (
    "ln(p.prior) - 0.5 * (ln(2 * pi() * p.v1) + ln(2 * pi() * p.v2) + ln(2 * pi() * p.v3) + ln(2 * pi() * p.v4))"
    " - 0.5 * ((x.l_quantity - p.m1) * (x.l_quantity - p.m1) / p.v1"
    " + (x.l_extendedprice - p.m2) * (x.l_extendedprice - p.m2) / p.v2"
    " + (x.order_year - p.m3) * (x.order_year - p.m3) / p.v3"
    " + (x.order_day - p.m4) * (x.order_day - p.m4) / p.v4)"
)
_SPREAD = (
    "1e-9 * greatest(var_pop(l_quantity), var_pop(l_extendedprice), var_pop(order_year), var_pop(order_day))"
)


def _params(rows: str, by: str = "") -> str:
    """Model parameters per class (and per ``by``) of a subquery with features and label."""
    g = f"{by}, " if by else ""
    on = f" AND s.{by} = e.{by}" if by else ""
    sel = f"s.{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"""
      SELECT {sel}s.label, s.n, s.n * 1.0 / e.total AS prior, m1, m2, m3, m4,
             v1 + eps AS v1, v2 + eps AS v2, v3 + eps AS v3, v4 + eps AS v4
      FROM (SELECT {g}label, count(*) AS n,
                   avg(l_quantity) AS m1, avg(l_extendedprice) AS m2, avg(order_year) AS m3, avg(order_day) AS m4,
                   var_pop(l_quantity) AS v1, var_pop(l_extendedprice) AS v2,
                   var_pop(order_year) AS v3, var_pop(order_day) AS v4
            FROM {rows} GROUP BY {g}label) s
      JOIN (SELECT {g}count(*) AS total, {_SPREAD} AS eps FROM {rows}{grp}) e ON true{on}"""


def _scored(rows: str, params: str, by: str = "") -> str:
    """Prediction and its probability per row."""
    on = f"x.{by} = p.{by}" if by else "true"
    return f"""
      SELECT o_orderkey, any_value(actual) AS actual, {f"any_value({by}) AS {by}," if by else ""}
             arg_max(class, (score, -class_rank)) AS prediction,
             1.0 / sum(exp(score - best)) AS probability
      FROM (SELECT *, max(score) OVER (PARTITION BY o_orderkey) AS best FROM (
              SELECT x.o_orderkey, x.label AS actual, {f"x.{by}," if by else ""} p.label AS class,
                     CASE p.label WHEN 'Late' THEN 0 ELSE 1 END AS class_rank, {_SCORE} AS score
              FROM {rows} x JOIN {params} p ON {on}))
      GROUP BY o_orderkey"""


def _cells(rows: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""
      SELECT {g}count(*) AS n,
             count(*) FILTER (actual = 'On time' AND prediction = 'On time') AS tp,
             count(*) FILTER (actual = 'Late' AND prediction = 'On time') AS fp,
             count(*) FILTER (actual = 'On time' AND prediction = 'Late') AS fn,
             count(*) FILTER (actual = 'Late' AND prediction = 'Late') AS tn
      FROM {rows} {f"GROUP BY {by}" if by else ""}"""


def _ratios(cells: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""
      SELECT {g}(tp + tn) * 1.0 / n AS accuracy,
             coalesce(tp * 1.0 / nullif(tp + fp, 0), 0) AS precision,
             coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) AS recall,
             coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
      FROM {cells}"""


def _uniform(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)"


_D2 = (
    "((a.l_quantity - b.l_quantity) * (a.l_quantity - b.l_quantity)"
    " + (a.l_extendedprice - b.l_extendedprice) * (a.l_extendedprice - b.l_extendedprice)"
    " + (a.order_year - b.order_year)::DOUBLE * (a.order_year - b.order_year)"
    " + (a.order_day - b.order_day)::DOUBLE * (a.order_day - b.order_day))"
)


def _synthetic(rows: str, by: str = "") -> str:
    """Synthetic minority rows of a labelled subquery (per round ``by``)."""
    g = f"{by}, " if by else ""
    eq = f" AND a.{by} = b.{by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    salt = f"{by} || ':' || " if by else ""
    a_by, o_by = (f"{t}.{by}, " if by else "" for t in ("a", "o"))
    return f"""
      SELECT {o_by}o.origin, nb.neighbor, o.copy, o.gap,
             o.l_quantity + o.gap * (nb.l_quantity - o.l_quantity) AS l_quantity,
             o.l_extendedprice + o.gap * (nb.l_extendedprice - o.l_extendedprice) AS l_extendedprice,
             o.order_year + o.gap * (nb.order_year - o.order_year) AS order_year,
             o.order_day + o.gap * (nb.order_day - o.order_day) AS order_day, 'On time' AS label
      FROM (
        SELECT *, {_uniform(f"'42:gap:' || {salt}origin || ':' || copy")} AS gap,
               floor({_uniform(f"'42:pick:' || {salt}origin || ':' || copy")} * 5)::BIGINT + 1 AS pick
        FROM (
          SELECT {g}o_orderkey AS origin, l_quantity, l_extendedprice, order_year, order_day,
                 unnest(range(1, each + CASE WHEN nth <= extra THEN 2 ELSE 1 END)) AS copy
          FROM (
            SELECT r.*, row_number() OVER ({part} ORDER BY md5('42:' || o_orderkey), o_orderkey) AS nth,
                   c.each, c.extra
            FROM (SELECT * FROM {rows} WHERE label = 'On time') r
            JOIN (SELECT {g}(late - few) // few AS each, (late - few) % few AS extra
                  FROM (SELECT {g}count(*) FILTER (label = 'Late') AS late,
                               count(*) FILTER (label = 'On time') AS few FROM {rows}
                        {f"GROUP BY {by}" if by else ""})) c {f"USING ({by})" if by else "ON true"})
        )) o
      JOIN (
        SELECT {a_by}a.o_orderkey AS origin, b.o_orderkey AS neighbor, b.l_quantity, b.l_extendedprice,
               b.order_year, b.order_day,
               row_number() OVER (PARTITION BY {a_by}a.o_orderkey ORDER BY {_D2}, b.o_orderkey) AS nearness
        FROM {rows} a JOIN {rows} b
          ON a.label = 'On time' AND b.label = 'On time' AND a.o_orderkey <> b.o_orderkey{eq}
      ) nb ON nb.origin = o.origin AND nb.nearness = o.pick {f"AND nb.{by} = o.{by}" if by else ""}"""


_BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "fact": ((), f"""
      SELECT l_orderkey AS o_orderkey, l_quantity, l_extendedprice, l_shipdate FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS rn FROM lineitem)
      WHERE rn = 1"""),
    "joined": (("fact",), """
      SELECT o.*, f.l_quantity, f.l_extendedprice, f.l_shipdate,
             date_diff('day', o.o_orderdate::DATE, f.l_shipdate::DATE)::INTEGER AS days,
             year(o.o_orderdate)::INTEGER AS order_year,
             date_diff('day', DATE '1995-01-01', o.o_orderdate::DATE)::INTEGER AS order_day
      FROM orders o LEFT JOIN fact f ON o.o_orderkey = f.o_orderkey"""),
    "star": (("joined",), "SELECT * FROM joined WHERE days IS NULL OR days >= 0"),
    "labelled": (("star",), """
      SELECT *, CASE WHEN days <= 365 THEN 'On time' ELSE 'Late' END AS label
      FROM star WHERE o_orderstatus = 'F'"""),
    "train": (("labelled",), """
      SELECT o_orderkey, l_quantity, l_extendedprice, order_year, order_day, label FROM labelled
      WHERE l_quantity IS NOT NULL AND NOT isnan(l_quantity)
        AND l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice) AND order_year IS NOT NULL"""),
    "infer": (("star",), """
      SELECT o_orderkey, l_quantity, l_extendedprice, order_year, order_day, NULL AS label FROM star
      WHERE o_orderstatus = 'O' AND l_quantity IS NOT NULL AND NOT isnan(l_quantity)
        AND l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice) AND order_year IS NOT NULL"""),
    "ranked": (("train",), """
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || o_orderkey), o_orderkey) AS place
      FROM train"""),
    "sizes": (("train",), """
      SELECT label, n, (base + CASE WHEN spare_rank <= n_train - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS n_dev
      FROM (SELECT *, floor(exact) AS base,
                   row_number() OVER (ORDER BY exact - floor(exact) DESC, label) AS spare_rank
            FROM (SELECT label, n, n_train, n_train * n / total::DOUBLE AS exact
                  FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total,
                               sum(count(*)) OVER () - ceil(0.2::DOUBLE * sum(count(*)) OVER ()) AS n_train
                        FROM train GROUP BY label)))"""),
    "parts": (("ranked", "sizes"), """
      SELECT r.*, CASE WHEN place <= n_dev THEN 'train' ELSE 'test' END AS part
      FROM ranked r JOIN sizes USING (label)"""),
    "fold_ends": (("sizes",), """
      SELECT label, fold, sum(size) OVER (PARTITION BY label ORDER BY fold) AS upto, size
      FROM (SELECT label, fold, CASE WHEN n_dev > first THEN (n_dev - first - 1) // 10 + 1 ELSE 0 END AS size
            FROM (SELECT label, n_dev, fold, (((fold - ahead) % 10) + 10) % 10 AS first
                  FROM (SELECT label, n_dev, coalesce(sum(n_dev) OVER (
                          ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
                        FROM sizes), (SELECT unnest(range(10)) AS fold)))"""),
    "folded": (("parts", "fold_ends"), """
      SELECT p.*, (SELECT min(fold) FROM fold_ends e WHERE e.label = p.label AND p.place <= e.upto)::INTEGER AS fold
      FROM parts p WHERE part = 'train'"""),
    "dev": (("parts",), "SELECT * FROM parts WHERE part = 'train'"),
    "test": (("parts",), "SELECT * FROM parts WHERE part = 'test'"),
    "rounds": (("folded",), """
      SELECT f.* REPLACE (r.fold AS fold) FROM folded f JOIN (SELECT unnest(range(10)) AS fold) r ON f.fold <> r.fold"""),
    "full_model": (("train",), _params("train")),
    "dev_model": (("dev",), _params("dev")),
    "round_models": (("rounds",), _params("rounds", "fold")),
    "full_fit": (("full_model",), _scored("train", "full_model")),
    "holdout": (("dev_model", "test"), _scored("test", "dev_model")),
    "predicted": (("full_model", "infer"), _scored("infer", "full_model")),
    "predicted_dev": (("dev_model", "infer"), _scored("infer", "dev_model")),
    "validated": (("round_models",), _scored("folded", "round_models", "fold")),
    "holdout_cells": (("holdout",), _cells("holdout")),
    "holdout_metrics": (("holdout_cells",), _ratios("holdout_cells")),
    "fold_cells": (("validated",), _cells("validated", "fold")),
    "fold_metrics": (("fold_cells",), _ratios("fold_cells", "fold")),
    "synthetic": (("train",), _synthetic("train")),
    "synthetic_dev": (("dev",), _synthetic("dev")),
    "synthetic_rounds": (("rounds",), _synthetic("rounds", "fold")),
    "balanced": (("synthetic",), """
      SELECT l_quantity, l_extendedprice, order_year, order_day, label FROM train
      UNION ALL SELECT l_quantity, l_extendedprice, order_year, order_day, label FROM synthetic"""),
    "balanced_dev": (("synthetic_dev",), """
      SELECT l_quantity, l_extendedprice, order_year, order_day, label FROM dev
      UNION ALL SELECT l_quantity, l_extendedprice, order_year, order_day, label FROM synthetic_dev"""),
    "balanced_rounds": (("synthetic_rounds",), """
      SELECT fold, l_quantity, l_extendedprice, order_year, order_day, label FROM rounds
      UNION ALL SELECT fold, l_quantity, l_extendedprice, order_year, order_day, label FROM synthetic_rounds"""),
    "smote_model": (("balanced",), _params("balanced")),
    "smote_dev_model": (("balanced_dev",), _params("balanced_dev")),
    "smote_round_models": (("balanced_rounds",), _params("balanced_rounds", "fold")),
    "smote_holdout": (("smote_dev_model", "test"), _scored("test", "smote_dev_model")),
    "smote_predicted": (("smote_model", "infer"), _scored("infer", "smote_model")),
    "smote_validated": (("smote_round_models",), _scored("folded", "smote_round_models", "fold")),
    "smote_cells": (("smote_holdout",), _cells("smote_holdout")),
    "smote_metrics": (("smote_cells",), _ratios("smote_cells")),
    "smote_fold_cells": (("smote_validated",), _cells("smote_validated", "fold")),
    "smote_fold_metrics": (("smote_fold_cells",), _ratios("smote_fold_cells", "fold")),
    "compared": (("predicted", "smote_predicted"), """
      SELECT a.o_orderkey, a.prediction AS label_a, b.prediction AS label_b
      FROM predicted a JOIN smote_predicted b ON a.o_orderkey = b.o_orderkey"""),
    "compared_dev": (("predicted", "predicted_dev"), """
      SELECT a.o_orderkey, a.prediction AS label_a, b.prediction AS label_b
      FROM predicted a JOIN predicted_dev b ON a.o_orderkey = b.o_orderkey"""),
}


def using(blocks: str, select: str) -> str:
    """``select`` with the named blocks, and whatever they need, in front."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for needed in _BLOCKS[name][0]:
                add(needed)
            ordered.append(name)

    for name in blocks.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_BLOCKS[n][1]})" for n in ordered) + f"\n{select}"


def pivot_metrics(row: str, metrics: str, subject: str) -> str:
    """Rows ``(subject, metric, value)`` from the named columns of a one-row source."""
    return "\nUNION ALL ".join(
        f"SELECT '{subject}' AS subject, '{m}' AS metric, {m}::BIGINT AS value FROM {row}" for m in metrics.split()
    )
