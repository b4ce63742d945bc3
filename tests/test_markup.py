"""Real-life tables: nested, with end tags left out, with cells that span."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from citylens.plans import traffic
from citylens.sources import markup


class Reader(HTMLParser):
    """The same tables by a stack of open ones, tag by tag."""

    def __init__(self):
        super().__init__()
        self.tables, self.stack = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.stack.append({"rows": self.tables[-1], "row": False, "cell": False})
        elif self.stack and tag in ("tr", "td", "th", "thead", "tbody", "tfoot"):
            top = self.stack[-1]
            top["cell"] = False
            if tag in ("td", "th"):
                if not top["row"]:
                    top["rows"].append([])
                spans = {k: max(1, int(v)) for k, v in attrs if k in ("colspan", "rowspan")}
                top["rows"][-1].append(["", spans.get("colspan", 1), spans.get("rowspan", 1)])
                top["row"] = top["cell"] = True
            else:
                top["row"] = tag == "tr"
                if tag == "tr":
                    top["rows"].append([])

    def handle_endtag(self, tag):
        if not self.stack:
            return
        if tag == "table":
            self.stack.pop()
        elif tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
            self.stack[-1]["cell"] = False
            if tag not in ("td", "th"):
                self.stack[-1]["row"] = False

    def handle_data(self, data):
        if self.stack and self.stack[-1]["cell"]:
            self.stack[-1]["rows"][-1][-1][0] += data


def grid_of(rows):
    taken, out = {}, []
    for r, row in enumerate(rows):
        c = 0
        for text, wide, high in row:
            for _ in range(wide):
                while (r, c) in taken:
                    c += 1
                for k in range(high):
                    taken[r + k, c] = text
        width = max((col + 1 for rr, col in taken if rr == r), default=0)
        out.append([(taken.get((r, k)) or "").strip() or None for k in range(width)])
    return out


def largest(page):
    reader = Reader()
    reader.feed(page or "")
    reader.close()
    grids = [grid_of(t) for t in reader.tables]
    area = lambda g: len(g) * max(map(len, g), default=0)
    return max(grids, key=area, default=None) if any(grids) else None


def random_table(draw, depth=0):
    out = [draw.choice(["<table>", "<TABLE class='a>b' id=\"x\">", "<table\n border=1>"])]
    for _ in range(draw.randint(0, 5)):
        if draw.random() < 0.1:
            out.append(draw.choice(["<tbody>", "</thead>", "<tfoot>"]))
        if draw.random() < 0.9:
            out.append(draw.choice(["<tr>", "<TR align=left>"]))
        for _ in range(draw.randint(0, 4)):
            spans = draw.choice(["", "", "", ' colspan=2', ' rowspan="2"', " ROWSPAN='3' colspan='2'", ' title="<b> & rowspan" colspan=0'])
            out.append(f"<{draw.choice(['td', 'th', 'TD'])}{spans}>{draw.choice(['', ' ', 'x', 'y<b>z</b>', '<i>1</i> 2'])}{draw.randint(0, 99)}")
            if depth < 2 and draw.random() < 0.15:
                out.append(random_table(draw, depth + 1) + draw.choice(["", " after "]))
            out.append(draw.choice(["", "</td>", "</th>"]))
        out.append(draw.choice(["", "</tr>", "</tr>\n"]))
    return "".join(out) + draw.choice(["</table>", "</table>", "" if depth == 0 else "</table >"])


def test_random_pages_match_a_tag_by_tag_reader(spark):
    draw = random.Random(21)
    pages = [(i, "<html><body>text" + "<p>".join(random_table(draw) for _ in range(draw.randint(0, 3))) + "</body>") for i in range(400)]
    frame = spark.createDataFrame(pages, "id int, html string").repartition(4)
    got = {r.id: r.grid for r in frame.select("id", markup.largest_table("html").alias("grid")).collect()}
    assert got == {i: largest(page) for i, page in pages}


@pytest.mark.parametrize("page, want", [
    (None, None), ("", None), ("<p>no table", None), ("<table></table>", None), ("</table></td><td>stray", None),
    ("<table><td>1<td>2<tr><td>3", [["1", "2"], ["3"]]),
    ("<table><tr><td>a<!-- <td>no</td> --><script>'<td>'</script><td>b</table>", [["a", "b"]]),
    ("<table><tr><td rowspan=3>a<td>b<tr><td colspan=2>c<tr></table>", [["a", "b"], ["a", "c", "c"], ["a"]]),
    ("<table><tr><td>out<table><tr><td>1<td>2<tr><td>3<td>4</table>side</table>", [["1", "2"], ["3", "4"]]),
    ("<table><tr><td>out <table><tr><td>1</table> side<td>b<td>c</table>", [["out  side", "b", "c"]]),
    ("<table><tr><td rowspan='99999999'>a<td colspan='x'>b</table>", [["a", "b"]]),
    ("<table><tr><th>a<tdx><trace>b</table>", [["ab"]]),
    ('<table><tr><td title="it\'s > all">a<td alt="open>b</table>', [["a", "b"]]),
])
def test_pages_by_hand(spark, page, want):
    frame = spark.createDataFrame([(page,)], "html string")
    assert frame.select(markup.largest_table("html").alias("grid")).first().grid == want


def test_nested_lists(spark):
    page = "<ul><li>a<li>b<ol><li>x</ol> tail</ul><ol><li>1<li>2<li>3</li></ol>"
    frame = spark.createDataFrame([(1, page)], "id int, html string")
    rows = markup.table_rows(frame, table="ul|ol", row="li", cell="").orderBy("pos").collect()
    assert [r.cells for r in rows] == [["1"], ["2"], ["3"]]


def test_a_long_table_keeps_all_rows(spark):
    rows = 20_000
    page = "<table>" + "".join(f"<tr><td>{i}<td>v{i}" for i in range(rows)) + "</table>"
    frame = spark.createDataFrame([(1, page)], "id int, html string")
    got = markup.table_rows(frame).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("cells")).alias("w"), F.sum(F.get("cells", F.lit(0)).cast("long")).alias("s")).first()
    assert (got.n, got.w, got.s) == (rows, 2, rows * (rows - 1) // 2)


def test_count_page_inside_a_layout_table(spark):
    head = "<tr><th colspan=3>All<tr><th><th>Mon<th><tr><th>Hour<th>2024-03-04<th>Workday"
    body = "".join(f"<tr><td>{h}<td>{v}<td>9" for h, v in [("00:00:00", "5"), ("01:00:00", ""), ("Total", "5")])
    page = f"<table><tr><td>menu<td><table>{head}{body}</table></table>"
    got = traffic.counts_from_pages(spark.createDataFrame([(1, page)], "id int, html string")).collect()
    assert sorted((r.hour, r["count"]) for r in got) == [("00:00:00", 5.0), ("01:00:00", None)]


def test_other_block_sizes_of_count_pages(spark):
    head = "<tr><th>x<th>y<tr><th>x<th>y<tr><th>Hour<th>2024-03-04"
    body = "".join(f"<tr><td>{h:02d}:00:00<td>{h}" for h in range(6))
    frame = spark.createDataFrame([(1, f"<table>{head}{body}</table>")], "id int, html string")
    got = traffic.counts_from_pages(frame, labels=["in", "out"], size=2).collect()
    assert sorted((r.direction, r.hour) for r in got) == [("in", "00:00:00"), ("in", "01:00:00"), ("out", "02:00:00"), ("out", "03:00:00")]
