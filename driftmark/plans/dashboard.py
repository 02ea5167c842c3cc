"""A self-contained HTML page to explore a scored run: facets, search, tool comparison, pages, navigation, export.

The page holds its records as JSON, so it is for runs that people review; a run with more records
than ``most`` raises, and its tables are to be queried with operators.explore instead.
"""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.operators import cases, explore
from driftmark.sources import tables

_STYLE = "body{font:14px sans-serif;margin:1.5em;color:#222}table{border-collapse:collapse;width:100%;margin:.5em 0}th,td{border:1px solid #ccc;padding:.25em .5em;text-align:left;vertical-align:top}th{background:#f2f2f2}.bar>*{margin-right:.6em}tr.on{background:#eef5ff}pre{white-space:pre-wrap;background:#f7f7f7;padding:.5em}"

_SCRIPT = """
const $ = id => document.getElementById(id), state = {page: 1, at: -1};
const facets = {dataset: 'dataset', comparison: 'comparison', first: 'first', second: 'second', error: 'error'};
const el = (tag, text) => { const e = document.createElement(tag); if (text !== undefined) e.textContent = text; return e; };
for (const [id, key] of Object.entries(facets)) {
  const values = [...new Set(records.flatMap(r => key === 'error' ? r.tools.map(t => t.error) : [r[key]]))].sort();
  $(id).append(new Option('all', ''), ...values.map(v => new Option(v, v)));
}
function chosen() {
  const q = $('search').value.toLowerCase();
  return records.filter(r => Object.entries(facets).every(([id, key]) => { const v = $(id).value; return !v || (key === 'error' ? r.tools.some(t => t.error === v) : r[key] === v); })
    && (!q || [r.id, r.input, r.truth, ...r.tools.flatMap(t => [t.error, t.note])].join('\\n').toLowerCase().includes(q)));
}
function show() {
  const all = chosen(), size = +$('size').value, pages = Math.max(1, Math.ceil(all.length / size));
  state.page = Math.min(Math.max(1, state.page), pages);
  $('where').textContent = `${all.length} records, page ${state.page} of ${pages}`;
  const body = $('rows'); body.replaceChildren();
  all.slice((state.page - 1) * size, state.page * size).forEach((r, i) => {
    const tr = el('tr'); tr.append(...[r.id, r.dataset, r.input, r.first, r.second, r.comparison].map(v => el('td', v)));
    tr.onclick = () => { state.at = (state.page - 1) * size + i; detail(); }; body.append(tr);
  });
  if (state.at >= all.length) state.at = -1;
}
function detail() {
  const all = chosen(), r = all[state.at], box = $('detail'); box.replaceChildren();
  if (!r) return;
  box.append(el('h3', r.id), el('pre', r.input), el('pre', 'truth ' + r.truth));
  for (const t of r.tools) box.append(el('h4', `${t.tool}: ${t.status} (${t.error})`), el('pre', t.prediction), el('p', t.note));
}
function move(step) { const n = chosen().length; if (n) { state.at = Math.min(n - 1, Math.max(0, state.at + step)); detail(); } }
function csv() {
  const cell = v => /[",\\n]/.test(v) ? '"' + v.replaceAll('"', '""') + '"' : v;
  const lines = [['id', 'dataset', 'input', 'first', 'second', 'comparison'], ...chosen().map(r => [r.id, r.dataset, r.input, r.first, r.second, r.comparison])];
  const a = el('a'); a.href = URL.createObjectURL(new Blob(['\\ufeff' + lines.map(l => l.map(cell).join(',')).join('\\n')], {type: 'text/csv'})); a.download = 'records.csv'; a.click();
}
for (const id of [...Object.keys(facets), 'search', 'size']) $(id).oninput = () => { state.page = 1; state.at = -1; show(); detail(); };
$('back').onclick = () => { state.page--; show(); }; $('next').onclick = () => { state.page++; show(); };
$('previous').onclick = () => move(-1); $('following').onclick = () => move(1); $('export').onclick = csv;
show();
"""


def records(predictions: DataFrame, first: str, second: str) -> DataFrame:
    """A row for each ID: data set, input, truth, the statuses of two tools, their comparison, and what every tool gave."""
    pairs = explore.tool_pairs(predictions, first, second)
    given = F.struct(F.col("CongCu").alias("tool"), F.col("DungSai").alias("status"), F.col("LoaiLoi").alias("error"), F.col("GhiChu").alias("note"), F.col("TruongDuDoan").alias("prediction"))
    every = predictions.groupBy("ID").agg(F.array_sort(F.collect_list(given)).alias("tools"))
    met = pairs.join(every, "ID").select(F.col("ID").alias("id"), cases.dataset_of(F.col("ID")).alias("dataset"), F.col("DiaChiGoc").alias("input"), F.col("TruongDung").alias("truth"), "first", "second", "comparison", "tools")
    return met.orderBy("id")


def table(df: DataFrame, most: int = 1000) -> str:
    """A small table as HTML."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else f'{v:.4f}' if isinstance(v, float) else str(v))}</{tag}>"
    line = lambda tag, vs: "<tr>" + "".join(cell(tag, v) for v in vs) + "</tr>"
    return "<table>" + line("th", df.columns) + "".join(line("td", r) for r in rows) + "</table>"


def build(predictions: DataFrame, found: dict[str, DataFrame], path: str | Path, title: str, first: str, second: str, most: int = 50_000, overwrite: bool = False) -> Path:
    """Write the page of a run, with its metric tables."""
    target = tables.guard(path, overwrite)
    rows = records(predictions, first, second).limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} records; query them with operators.explore")
    data = "[" + ",\n".join(rows).replace("</", "<\\/") + "]"
    choices = "".join(f'<label>{name} <select id="{key}"></select></label>' for name, key in (("data set", "dataset"), ("comparison", "comparison"), (html.escape(first), "first"), (html.escape(second), "second"), ("error", "error")))
    sizes = "".join(f"<option>{n}</option>" for n in explore.PAGE_SIZES)
    body = "".join(f"<h2>{html.escape(name)}</h2>{table(df)}" for name, df in found.items())
    page = f"""<!doctype html><html lang="vi"><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style>
<h1>{html.escape(title)}</h1>{body}
<h2>records</h2><div class="bar">{choices}<input id="search" placeholder="search"><select id="size">{sizes}</select><button id="export">CSV</button></div>
<p class="bar"><span id="where"></span><button id="back">&lt;</button><button id="next">&gt;</button><button id="previous">previous record</button><button id="following">next record</button></p>
<table><thead><tr><th>ID</th><th>data set</th><th>input</th><th>{html.escape(first)}</th><th>{html.escape(second)}</th><th>comparison</th></tr></thead><tbody id="rows"></tbody></table>
<div id="detail"></div><script>const records = {data};{_SCRIPT}</script></html>
"""
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(page, encoding="utf-8")
    return target


def filtered(rows: DataFrame, dataset: str | None = None, comparison: str | None = None, first: str | None = None, second: str | None = None, error: str | None = None, term: str = "") -> DataFrame:
    """The page's filters on a table of ``records`` of any size."""
    for column, value in {"dataset": dataset, "comparison": comparison, "first": first, "second": second}.items():
        if value:
            rows = rows.where(F.col(column) == value)
    if error:
        rows = rows.where(F.exists("tools", lambda t: t["error"] == error))
    said = rows.withColumn("dm_said", F.array_join(F.transform("tools", lambda t: F.concat_ws("\n", t["error"], t["note"])), "\n"))
    return explore.search(said, term, ["id", "input", "truth", "dm_said"]).drop("dm_said")


def options(rows: DataFrame, **chosen) -> DataFrame:
    """(facet, option, n): the page's option lists with their counts under the chosen filters, of a table of ``records`` of any size."""
    few = filtered(rows, **chosen)
    return explore.facets(few, ["dataset", "comparison", "first", "second"])
