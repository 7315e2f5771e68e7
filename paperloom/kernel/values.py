"""Fixed values that outputs are defined by: character sets, tables, themes and XML formats."""

from __future__ import annotations

# -- characters
RTL = ("\u0590", "\u08ff")
BIDI_CONTROLS = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
LRI, PDI = "\u2066", "\u2069"
CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">", "（": "）", "［": "］", "｛": "｝", "【": "】", "「": "」", "『": "』", "〈": "〉", "《": "》"}
OPENERS = set("([{<\"'“‘«‹（［｛【「『〈《$€£¥₪₹₩")
TRAILING = ".,;:!?"

# -- LaTeX
SYMBOLS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Pi": "Π", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    "pm": "±", "mp": "∓", "times": "×", "cdot": "·", "div": "÷", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "neq": "≠", "approx": "≈", "infty": "∞", "partial": "∂", "nabla": "∇",
    "sum": "∑", "prod": "∏", "int": "∫", "oint": "∮", "to": "→", "rightarrow": "→", "leftarrow": "←", "leftrightarrow": "↔", "in": "∈", "notin": "∉", "subset": "⊂", "supset": "⊃", "subseteq": "⊆", "supseteq": "⊇",
    "cup": "∪", "cap": "∩", "forall": "∀", "exists": "∃", "neg": "¬", "land": "∧", "lor": "∨", "ldots": "…", "cdots": "⋯", "degree": "°", "quad": "  ", "qquad": "    ",
    "sin": "sin", "cos": "cos", "tan": "tan", "log": "log", "ln": "ln", "lim": "lim", "max": "max", "min": "min", "det": "det",
}
FRACTIONS = {"frac", "dfrac", "tfrac"}
GROUPS = {"text", "mathrm", "operatorname"}
DROPPED = {"left", "right", "displaystyle"}
MATRICES = {"bmatrix": ("[", "]"), "pmatrix": ("(", ")"), "matrix": ("", "")}

# -- theme: sizes in half-points, spacing in twentieths of a point
FONT, BODY_COLOR, BODY_SIZE, BODY_AFTER, BODY_LINE = "Arial", "1F2937", 23, 80, 276
HEADING_BORDER, TABLE_BORDER, TABLE_INNER, HEADER_FILL, QUOTE_FILL, QUOTE_BORDER = "D9E2F3", "B7C9DB", "D9E2EC", "D9EAF7", "F8FAFC", "5B7FA3"
#: level: size, colour, space before, space after
HEADINGS = {1: (42, "17365D", 0, 100), 2: (32, "1F4E79", 180, 60), 3: (27, "334155", 140, 40), 4: (24, "334155", 120, 40), 5: (22, "475569", 100, 30), 6: (21, "475569", 80, 30)}

# -- package
CREATOR, APPLICATION, TITLE = "paperloom canonical compiler", "paperloom", "paperloom document"
W_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
M_NS = "http://schemas.openxmlformats.org/officeDocument/2006/math"
PARTS = ["[Content_Types].xml", "_rels/.rels", "word/document.xml", "word/styles.xml", "word/numbering.xml", "word/_rels/document.xml.rels", "docProps/core.xml", "docProps/app.xml"]

# -- rich HTML: bare tags and what they become
_MONO = "font-family:'Courier New',monospace;font-size:9.5pt;"
_TABLE = "border-collapse:collapse;border-spacing:0;width:100%;margin:6pt 0;table-layout:auto;"
_CELL = "border:0.75pt solid #b7c9db;padding:4pt 5pt;text-align:center;vertical-align:middle;line-height:1.0;"
QUOTE_RTL = '<blockquote dir="auto" style="margin:6pt 0;padding:5pt 10pt;background:#f8fafc;border-right:1.75pt solid #5b7fa3;border-left:0;color:#374151;">'
TAG_STYLES = [
    ("<p>", '<p dir="auto" style="margin:0 0 4pt 0;line-height:1.15;mso-line-height-rule:auto;">'),
    ("<hr />", '<hr style="border:0;border-top:0.75pt solid #d9e2f3;margin:8pt 0;" />'),
    ("<blockquote>", QUOTE_RTL),
    ("<ul>", '<ul dir="auto" style="margin:3pt 0 5pt 0;padding-inline-start:22pt;">'),
    ("<ol>", '<ol dir="auto" style="margin:3pt 0 5pt 0;padding-inline-start:22pt;">'),
    ("<li>", '<li dir="auto" style="margin:0 0 2pt 0;line-height:1.15;">'),
    ("<pre>", f'<pre dir="ltr" style="{_MONO}line-height:1.2;background:#f3f4f6;border:1px solid #d1d5db;border-radius:3px;padding:7pt;margin:6pt 0;white-space:pre-wrap;word-break:break-word;text-align:left;">'),
    ("<code>", f'<code dir="ltr" style="{_MONO}background:#f3f4f6;color:#7f1d1d;padding:1pt 2pt;unicode-bidi:isolate;">'),
    ('<table dir="rtl">', f'<table dir="rtl" style="{_TABLE}direction:rtl;mso-table-lspace:0pt;mso-table-rspace:0pt;">'),
    ("<table>", f'<table dir="ltr" style="{_TABLE}mso-table-lspace:0pt;mso-table-rspace:0pt;">'),
    ("<th>", f'<th style="{_CELL}background:#d9eaf7;color:#17365d;font-weight:700;">'),
    ("<td>", f'<td style="{_CELL}">'),
    ("<dl>", '<dl dir="auto" style="margin:4pt 0;">'),
    ("<dt>", '<dt style="font-weight:700;margin-top:3pt;">'),
    ("<dd>", '<dd style="margin:0 0 3pt 18pt;">'),
]
CODE_CLASS = f'<code dir="ltr" style="{_MONO}background:transparent;color:#111827;unicode-bidi:isolate;" class="'
MATH_STYLE = {
    True: "display:block;text-align:center;margin:5pt auto;font-family:'Cambria Math','Times New Roman',serif;font-size:11.5pt;line-height:1.35;unicode-bidi:isolate;",
    False: "font-family:'Cambria Math','Times New Roman',serif;font-size:11.5pt;unicode-bidi:isolate;white-space:nowrap;",
}


def points(value: int, unit: int) -> str:
    """A size in points, with one decimal only where it is needed."""
    size = value / unit
    return f"{size:.0f}" if size == int(size) else f"{size:.1f}"


def heading_tag(level: int) -> str:
    size, color, before, after = HEADINGS[level]
    border = f"padding:0 0 3pt 0;border-bottom:0.75pt solid #{HEADING_BORDER.lower()};" if level == 1 else ""
    return f'<h{level} dir="auto" style="font-family:{FONT},sans-serif;font-size:{points(size, 2)}pt;line-height:1.1;color:#{color.lower()};margin:{points(before, 20)}pt 0 {points(after, 20)}pt 0;{border}font-weight:700;">'
