"""The patterns that features of Markdown sources are counted by.

One definition for the column expressions (with the flag U, where the rules mean Unicode
white space and digits) and for plain Python. Lines are matched one by one where a pattern
starts with ^ and ends with $. Loops over groups are possessive: they neither recurse nor
go back, so that lines of any length end. A table rule lies within one line. Patterns begin
with a sign, and look behind after it, so that a search skips to the places of that sign."""

HEADING = r"^\s{0,3}(#{1,6})\s++\S"
SETEXT = {1: r"^\s*=+\s*$", 2: r"^\s*-{3,}\s*$"}
LIST_ITEM = r"^[^\S\n]*+(?:[-+*]|\d++[.)])\s++\S"
TABLE_RULE = r"^[^\S\n]*+\|?+[^\S\n]*+:?+-{3,}+:?+[^\S\n]*+(?:\|[^\S\n]*+:?+-{3,}+:?+[^\S\n]*+)++\|?+[^\S\n]*+$"
LINK = r"\[(?<!!\[)[^\]\n]*+(?:\](?:\([^) \n]+(?:\s+\"[^\"]*\")?\))?+)?+"
#: Which of what LINK finds (each stretch up to its first closing bracket, once) are links.
WHOLE_LINK = r"^\[[^\]\n]+\]\("
INLINE_MATH = r"\$(?<![\\$]\$)(?![\s$\d])(.+?)(?<![\s\\])\$(?!\$)"
LINE_MATH = r"\$\$(?<!\\\$\$)(?!\s*$).+?(?<!\\)\$\$"
BARE_MATH = r"^\s*\$\$\s*$"
THEMATIC_BREAK = r"^\s{0,3}(?:\*\s*+){3,}+$|^\s{0,3}(?:-\s*+){3,}+$|^\s{0,3}(?:_\s*+){3,}+$"
CODE = r"`(?<!``)(?!`)[^`\n]+`"
CODE_SPAN = r"`(?<!``)(?!`)[^`\n]*`"
QUOTE = r"^\s*+(?:>\s*+)++"
QUOTED = r"^\s*>"
FENCE = r"^(`{3,}|~{3,})"
#: Marks that a reader does not see.
MARKERS = r"==|\+\+|\|\||~~|\*\*|__|~(?<!~~)(?!~)|\^|\*(?<!\*\*)(?!\*)"
TOKEN = r"[^\W_]+"
