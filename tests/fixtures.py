"""The seven-page graph and small HTML pages that several tests use."""

GRAPH = {
    "1": ("1", "where the walk begins", ["2", "3", "7"]),
    "2": ("2", "leads back and on", ["1", "3", "7"]),
    "3": ("3", "the crossing of most ways", ["4", "2", "1"]),
    "4": ("4", "", ["5", "3"]),
    "5": ("5", "", ["4"]),
    "6": ("6", "", ["1"]),
    "7": ("7", "", ["6"]),
}


def fixture_rows(graph=GRAPH):
    return [(name, title, text, [f"/wiki/{x}" for x in links]) for name, (title, text, links) in graph.items()]


def graph_edges(graph=GRAPH):
    return {(a, b) for a, (_, _, links) in graph.items() for b in links if b in graph}


def html(graph=GRAPH):
    out = []
    for name, (title, text, links) in graph.items():
        head = f'<p id = "title">{title}</p>\n' + (f'<p id = "description">{text}</p>\n' if text else "")
        out.append((name, head + "".join(f"<a>{x}</a>\n" for x in links)))
    return out
