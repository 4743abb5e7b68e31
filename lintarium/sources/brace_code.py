"""Facts of Rust and JavaScript or TypeScript files, by a tokenizer and matched brackets.

There is no parser for these languages here, so what needs types or a full grammar is approximate: the facts are those
that tokens, brackets and the tokens around them show.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from lintarium.sources.facts import Facts

# Names that rules look for.
RUST_BIND = {"bind", "bind_addr", "new"}
RUST_DANGEROUS = {"gets", "gets_s", "strcpy", "strcat", "sprintf", "vsprintf", "scanf", "wcscpy", "wcscat"}
RUST_PARSERS = {"from_bytes", "from_raw", "parse_unchecked", "from_utf8_unchecked", "from_raw_parts", "from_raw_parts_mut", "from_ptr"}
RUST_LOGS = {"trace", "debug", "info", "warn", "error", "log"}
JS_BIND = {"listen", "bind"}
JS_LOG_OBJECTS = {"logger", "log", "console", "winston", "pino"}
JS_LOG_METHODS = {"log", "info", "warn", "error", "debug", "trace", "fatal"}
PLACEHOLDERS = ("%s", "%d", "%r", "%v", "{}")

_RUST = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>b?r(?P<h>\#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*"|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])')|(?P<life>'\w+)|(?P<word>[A-Za-z_]\w*|\d[\w.]*)|(?P<op>::|->|=>|==|!=|<=|>=|&&|\|\||\.\.=|\.\.|[^\s\w])""", re.S | re.X)
_JS = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<word>[A-Za-z_$][\w$]*|\d[\w.]*)|(?P<op>===|!==|=>|==|!=|<=|>=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^]=|\.\.\.|[^\s\w$])""", re.S | re.X)
_REGEX_BEFORE = {"(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "=>", "return", "typeof", "case"}
_JS_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


class Source:
    """Tokens without comments, the partner of each bracket, and the comments."""

    def __init__(self, f: Facts, pattern: re.Pattern, regexes: bool):
        self.f, self.tokens, self.comments, at = f, [], [], 0
        while at < len(f.text):
            m = pattern.match(f.text, at)
            if m is None:
                at += 1
                continue
            kind = "string" if m["string"] else "comment" if m["comment"] else "word" if m["word"] else "op"
            if regexes and m[0] == "/" and (not self.tokens or self.tokens[-1].text in _REGEX_BEFORE) and (r := _JS_REGEX.match(f.text, at)):
                self.tokens.append(Token("regex", r[0], at, r.end()))
                at = r.end()
                continue
            (self.comments if kind == "comment" else self.tokens).append(Token(kind, m[0], at, m.end()))
            at = m.end()
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in "([{":
                stack.append(i)
            elif t.kind == "op" and t.text in ")]}":
                if not stack:
                    raise SyntaxError(f"no bracket is open at offset {t.start}")
                j = stack.pop()
                if "([{".index(self.tokens[j].text) != ")]}".index(t.text):
                    raise SyntaxError(f"brackets don't match at offset {t.start}")
                self.partner[i], self.partner[j] = j, i
        if stack:
            raise SyntaxError(f"a bracket stays open at offset {self.tokens[stack[-1]].start}")
        self.texts = [t.text if t.kind != "string" else '"' for t in self.tokens]

    def __len__(self) -> int:
        return len(self.tokens)

    def text(self, i: int) -> str:
        return self.texts[i] if 0 <= i < len(self.texts) else ""

    def add(self, kind: str, name: str | None, first: int, last: int, **attrs) -> None:
        self.f.add(kind, name, self.tokens[first].start, self.tokens[min(last, len(self) - 1)].end, **attrs)

    def next_brace(self, i: int, stop: str = ";") -> int:
        """The next { outside other brackets, or -1 if one of ``stop`` comes first."""
        while i < len(self):
            t = self.text(i)
            if t == "{":
                return i
            if t in ("(", "["):
                i = self.partner[i]
            elif t in stop or t in (")", "]", "}"):
                return -1
            i += 1
        return -1

    def items(self, first: int, last: int) -> int:
        """Number of parts between commas inside a bracket."""
        if last - first <= 1:
            return 0
        n, i, angle = 1, first + 1, 0
        while i < last:
            t = self.text(i)
            if t in ("(", "[", "{"):
                i = self.partner[i]
            elif t == "<":
                angle += 1
            elif t == ">" and angle:
                angle -= 1
            elif t == "," and not angle and i + 1 < last:
                n += 1
            i += 1
        return n

    def statements(self, first: int, last: int) -> list[tuple[int, int]]:
        """Token ranges of the statements of a block, whose braces are ``first`` and ``last``."""
        out, i, begin = [], first + 1, first + 1
        while i < last:
            t = self.text(i)
            if t in ("(", "["):
                i = self.partner[i]
            elif t == "{":
                i = self.partner[i]
                if self.text(i + 1) not in ("else", "catch", "finally", ".", ",", ")", ";", "?", "=", "while") or (self.text(i + 1) == "while" and self.text(begin) != "do"):
                    out.append((begin, i))
                    begin = i + 1
            elif t == ";":
                if begin < i:
                    out.append((begin, i))
                begin = i + 1
            i += 1
        if begin < last:
            out.append((begin, last - 1))
        return out

    def value(self, i: int) -> str:
        """The text of a string token without its quotes."""
        return re.sub(r"""^b?r?\#*["'`]|["'`]\#*$""", "", self.tokens[i].text)


def _comments(s: Source) -> None:
    for c in s.comments:
        doc = c.text.startswith(("///", "//!", "/**", "/*!"))
        body = re.sub(r"^(///?!?|/\*[*!]?)|\*/$", "", c.text).strip()
        s.f.add("doc" if doc and len(c.text) > 4 else "comment", None, c.start, c.end, text=body)
        if doc:
            s.f.add("comment", None, c.start, c.end, text=body)


def _doc_before(s: Source, at: int) -> str | None:
    """The doc comment that ends right before a place, attributes and modifiers aside."""
    found = [c for c in s.comments if c.end <= at and c.text.startswith(("///", "/**"))]
    if not found:
        return None
    between = s.f.text[found[-1].end : at]
    between = re.sub(r"#\[[^\]]*\]|@\w+(\([^)]*\))?|\b(pub(\([^)]*\))?|async|unsafe|const|extern|export|default|static|public|private|protected|function)\b|\"C\"", "", between)
    if between.strip():
        return None
    lines = [found[-1]]
    for c in reversed(found[:-1]):
        if s.f.text[c.end : lines[-1].start].strip() or s.f.line(c.end) < s.f.line(lines[-1].start) - 1:
            break
        lines.append(c)
    return "\n".join(re.sub(r"^(///|/\*\*)|\*/$", "", c.text).strip() for c in reversed(lines))


def _complexity(s: Source, first: int, last: int, words: set[str], loops: set[str], ops: set[str]) -> dict:
    cyclo, cog, nest, returns, depth = 1, 0, 0, 0, []
    for i in range(first, last + 1):
        t = s.text(i)
        while depth and i > depth[-1]:
            depth.pop()
        if t in words and not (t == "if" and s.text(i - 1) == "else"):
            cyclo += 1
            cog += len(depth) + 1
        elif t == "if":
            cyclo += 1
            cog += 1
        elif t == "else" and s.text(i + 1) != "if":
            cog += 1
        elif t in ops:
            cyclo += 1
            cog += 1
        elif t == "return":
            returns += 1
        if t in words or t in loops or t in ("else", "switch", "match", "try", "catch"):
            brace = s.next_brace(i + 1)
            if first < brace <= last:
                depth.append(s.partner[brace])
                nest = max(nest, len(depth))
    return {"cyclomatic": cyclo, "cognitive": cog, "nesting": nest, "returns": returns}


def _function(s: Source, name: str | None, head: int, open_paren: int, brace: int, **attrs) -> None:
    end, f = s.partner[brace], s.f
    a, b = s.tokens[brace].start, s.tokens[end].end
    params = [x for x in re.findall(r"[A-Za-z_$][\w$]*", " ".join(s.text(i) for i in range(open_paren + 1, s.partner[open_paren])))]
    s.add("function", name, head, end, params=s.items(open_paren, s.partner[open_paren]) - (s.text(open_paren + 1) in ("self", "&") and "self" in params[:3]), param_names=",".join(params), body_start=f.byte(a), body_end=f.byte(b), body_lines=f.line(b) - f.line(a) + 1, body=f.text[a:b], signature=f.text[s.tokens[head].start : a], region=f.text[max(0, s.tokens[head].start - 256) : b], doc=_doc_before(s, s.tokens[head].start), **attrs)


def _unreachable(s: Source, first: int, enders: set[str]) -> None:
    stmts = s.statements(first, s.partner[first])
    for (a, _), (b, e) in zip(stmts, stmts[1:]):
        if s.text(a) in enders and s.text(b) not in ("case", "default", "fn", "function", "use", "const"):
            s.add("unreachable_stmts", None, b, e)
            return


def rust(f: Facts) -> None:
    s = Source(f, _RUST, False)
    _comments(s)
    send = re.search(r"unsafe\s+impl(?:<[^>]*>)?\s+Send\b", f.text) is not None
    impl_ends: list[tuple[int, str]] = []
    fn_ends: list[tuple[int, str]] = []
    externs: list[int] = []
    loops: list[int] = []
    macros = False
    attrs: list[str] = []
    for i, t in enumerate(s.tokens):
        w, before, after = s.text(i), s.text(i - 1), s.text(i + 1)
        for stack in (impl_ends, fn_ends):
            while stack and i > stack[-1][0]:
                stack.pop()
        for stack in (externs, loops):
            while stack and i > stack[-1]:
                stack.pop()
        if t.kind == "string":
            s.add("string", None, i, i, value=s.value(i))
            continue
        if w == "[" and before == "#":
            attrs.append(f.text[t.start : s.tokens[s.partner[i]].end])
        if w in (";", "}") and not before == "]":
            attrs = [] if w == "}" or before != "]" else attrs
        head = i
        while s.text(head - 1) in ("pub", "async", "unsafe", "const", "extern", '"', "static", "mut") or (s.text(head - 1) == ")" and s.text(s.partner[head - 1] - 1) == "pub"):
            head = s.partner[head - 1] - 1 if s.text(head - 1) == ")" else head - 1
        words = {s.text(k) for k in range(head, i)}
        if w == "use" and before in ("", ";", "}", "pub", ")", "]", "{"):
            j = i
            while j < len(s) and s.text(j) != ";":
                j += 1
            s.add("import", re.sub(r"\s+", "", f.text[t.end : s.tokens[min(j, len(s) - 1)].start]), i, j, top=not fn_ends)
        elif w == "mod" and s.tokens[min(i + 1, len(s) - 1)].kind == "word":
            s.add("module", after, i, i + 1)
        elif w == "impl":
            b = s.next_brace(i)
            if b > 0:
                names = [s.text(k) for k in range(i + 1, b) if s.tokens[k].kind == "word"]
                impl_ends.append((s.partner[b], names[names.index("for") + 1] if "for" in names[:-1] else (names or [""])[-1] if "<" not in f.text[t.start : s.tokens[b].start] else names[0] if len(names) == 1 else names[-2] if names else ""))
                if "unsafe" in words:
                    s.add("unsafe_items", "impl", head, b)
        elif w in ("struct", "enum", "trait", "union") and s.tokens[min(i + 1, len(s) - 1)].kind == "word" and before not in (".", "::"):
            b = s.next_brace(i)
            end = s.partner[b] if b > 0 else i + 1
            s.add("type", after, head, end, visibility="Public" if "pub" in words else "Private", doc=_doc_before(s, s.tokens[head].start), top=True)
            if w == "trait" and "unsafe" in words:
                s.add("unsafe_items", "trait", head, end)
            if w == "struct" and "pub" in words and b > 0 and not send and re.search(r":\s*(?:&\s*|\[|\()?\*\s*(?:const|mut)\b", f.text[s.tokens[b].start : s.tokens[end].end]):
                s.add("pub_struct_with_raw_ptr", after, head, end)
            if any("deprecated" in a for a in attrs):
                s.add("deprecated_items", after, head, end)
            attrs = []
        elif w == "fn" and s.tokens[min(i + 1, len(s) - 1)].kind == "word":
            p = i + 2
            while p < len(s) and s.text(p) != "(":
                p += 1
            if p >= len(s):
                continue
            b = s.next_brace(s.partner[p] + 1)
            pub, unsafe = "pub" in words, "unsafe" in words
            sig = f.text[s.tokens[head].start : s.tokens[b if b > 0 else s.partner[p]].start]
            test = any(re.match(r"\[(\w+::)*test\b", a) for a in attrs)
            if unsafe:
                s.add("unsafe_items", "fn", head, i + 1)
                if pub:
                    s.add("pub_unsafe_fns", after, head, i + 1)
            if pub and re.search(r"\*\s*(const|mut)\b", sig):
                s.add("raw_ptr_pub_apis", after, head, s.partner[p])
            if externs and unsafe and not re.search(r"(?i)//+\s*safety:", f.line_text(f.line(s.tokens[head].start) - 1)):
                s.add("extern_unsafe_fns_no_doc", after, head, i + 1)
            if any("deprecated" in a for a in attrs):
                s.add("deprecated_items", after, head, i + 1)
            attrs = []
            if b > 0:
                end = s.partner[b]
                body = [s.text(k) for k in range(b, end)]
                _function(s, after, head, p, b, fn_kind="Method" if impl_ends else "Function", visibility="Public" if pub else "Private", is_async="async" in words, is_test=test, parent=impl_ends[-1][1] if impl_ends else None, top=not fn_ends, **_complexity(s, b, end, {"if", "while", "for", "loop", "match"} - {"match"}, {"loop"}, {"&&", "||", "?"}))
                if "unsafe" in body and RUST_PARSERS & set(body):
                    s.add("unsafe_with_parser_calls", after, head, end)
                names = ",".join(re.findall(r"(\w+)\s*:", f.text[s.tokens[p].start : s.tokens[s.partner[p]].end]))
                fn_ends.append((end, names))
        elif w == "extern" and s.text(i + 1) == '"' and s.text(i + 2) == "{":
            externs.append(s.partner[i + 2])
        elif w == "unsafe" and after == "{":
            s.add("unsafe_items", "block", i, s.partner[i + 1])
            line = f.line(t.start)
            if not any(re.search(r"(?i)//+\s*safety:", f.line_text(k)) for k in (line - 1, line)):
                s.add("unsafe_blocks_without_safety", None, i, s.partner[i + 1])
        elif w == "static" and after == "mut":
            if "pub" in words:
                s.add("mutable_global", s.text(i + 2), head, i + 2)
        elif w == "match" and before not in (".", "::"):
            b = s.next_brace(i)
            if b > 0:
                end, arms, wild, k = s.partner[b], 0, False, b + 1
                while k < end:
                    if s.text(k) == "=>":
                        arms += 1
                        m = k - 1
                        wild |= s.text(m) == "_" and s.text(m - 1) in ("{", ",", "}", "|")
                        if s.text(k + 1) == "{":
                            k = s.partner[k + 1]
                    elif s.text(k) in ("(", "[", "{"):
                        k = s.partner[k]
                    k += 1
                subject = [s.tokens[k] for k in range(i + 1, b)]
                lone = len(subject) == 1
                kind = "Literal" if lone and (subject[0].kind == "string" or subject[0].text[0].isdigit()) else "LowerPath" if subject and all(x.text == "::" or x.kind == "word" for x in subject) and subject[-1].text[0].islower() else "Other"
                s.add("match_sites", None, i, end, has_wildcard=wild, scrutinee=kind)
                s.add("long_dispatch_sites", "match", i, i, n=arms)
        elif w in ("for", "while", "loop") and before not in (".", "::", "impl") and not (w == "for" and after == "<"):
            b = s.next_brace(i)
            if b > 0:
                loops.append(s.partner[b])
                if w != "loop" and s.partner[b] == b + 1:
                    s.add("empty_blocks", w, b, b + 1)
                if w == "loop" and not _leaves(s, b, {"break", "return"}, {"panic", "unreachable", "todo", "exit"}):
                    s.add("infinite_loops", None, i, s.partner[b])
        elif w == "if":
            b = s.next_brace(i)
            if b > 0 and s.partner[b] == b + 1:
                s.add("empty_blocks", w, b, b + 1)
            if before != "else" and b > 0:
                n, k = 1, s.partner[b]
                while s.text(k + 1) == "else" and s.text(k + 2) == "if" and (nb := s.next_brace(k + 3)) > 0:
                    n, k = n + 1, s.partner[nb]
                if n >= 2:
                    s.add("long_dispatch_sites", "if", i, i, n=n)
        elif w in ("let", "const", "static") and not (w == "const" and after in ("fn", "unsafe", "mut")):
            k = i + 1 + (s.text(i + 1) == "mut")
            name, e = s.text(k), k + 1
            while e < len(s) and s.text(e) not in ("=", ";", "{"):
                e += 1
            if s.text(e) == "=" and s.text(e + 2) == ";" and (s.tokens[e + 1].kind == "string" or s.text(e + 1)[:1].isdigit()):
                s.add("assignments", name, i, e + 1, value=s.value(e + 1), literal="Str" if s.tokens[e + 1].kind == "string" else "Int")
        elif after == "!" and s.text(i + 2) in ("(", "[", "{") and t.kind == "word":
            close = s.partner[i + 2]
            macros |= close > i + 3
            if w in ("dbg", "println", "eprintln"):
                s.add("debug_calls", w, i, close)
            if w in RUST_LOGS:
                first = s.value(i + 3) if s.tokens[i + 3].kind == "string" else ""
                shaped = re.search(r"\{[^}]*\}", first) is not None or any(m in first for m in PLACEHOLDERS)
                idents = {s.text(k) for k in range(i + 4, close) if s.tokens[k].kind == "word"} | set(re.findall(r"\{(\w+)", first))
                s.add("log_calls", w, i, close, placeholder=shaped, args=",".join(sorted(idents)), params=fn_ends[-1][1] if fn_ends else "")
            if w in ("vec", "format") and loops:
                s.add("allocs_in_loop", w, i, close)
        if w == "transmute" and after in ("(", "::"):
            s.add("transmute_calls", w, i, i + 1)
        if after == "(" and t.kind == "word":
            if w in RUST_DANGEROUS and before != "fn":
                s.add("dangerous_calls", w, i, i + 1)
            if w in RUST_BIND and before == "::":
                s.add("bind_call_sites", w, i, i + 1, arg=s.value(i + 2) if i + 2 < len(s) and s.tokens[i + 2].kind == "string" else None)
            if loops and ((before == "." and w in ("to_string", "to_owned")) or (before == "::" and s.text(i - 2) in ("Vec", "String", "Box", "HashMap", "BTreeMap") and w in ("new", "from", "with_capacity"))):
                s.add("allocs_in_loop", w, i, i + 1)
        if w == "{":
            end = s.partner[i]
            _unreachable(s, i, {"return", "break", "continue"})
            own = [k for a, b in s.statements(i, end) for k in range(a, b + 1)]
            if any(s.text(k) in ("iter", "into_iter", "iter_mut") and s.text(k - 1) == "." for k in own):
                for k in own:
                    if s.text(k) == "clone" and s.text(k - 1) == "." and s.text(k + 1) == "(":
                        s.add("clone_in_iter_chains", None, k, k + 2)
    f.add("has_macro_body", str(macros).lower(), 0, 0)


def _leaves(s: Source, brace: int, words: set[str], calls: set[str]) -> bool:
    """Whether a loop's body has an exit at its own level, not looking into inner loops and closures."""
    i, end = brace + 1, s.partner[brace]
    while i < end:
        w = s.text(i)
        if w in words or (w in calls and s.text(i + 1) in ("!", "(")):
            return True
        if w in ("for", "while", "loop") and (b := s.next_brace(i)) > 0 or w in ("|", "function", "=>") and s.text(i + 1) == "{" and (b := i + 1):
            i = s.partner[b]
        i += 1
    return False


def js(f: Facts) -> None:
    s = Source(f, _JS, True)
    _comments(s)
    scopes: list[tuple[int, str, str]] = []  # end, parameters, id of the function
    classes: list[tuple[int, str]] = []
    for i, t in enumerate(s.tokens):
        w, before, after = s.text(i), s.text(i - 1), s.text(i + 1)
        while scopes and i > scopes[-1][0]:
            scopes.pop()
        while classes and i > classes[-1][0]:
            classes.pop()
        if t.kind == "string":
            s.add("string", None, i, i, value=s.value(i))
            continue
        if t.kind == "regex":
            s.add("regex", None, i, i, value=t.text[1 : t.text.rindex("/")])
            continue
        exported = any(s.text(k) == "export" for k in (i - 1, i - 2, i - 3))
        if w == "import" and before in ("", ";", "}", '"', ")") or (w == "export" and "from" in [s.text(k) for k in range(i, min(i + 12, len(s)))]):
            j = i + 1
            while j < len(s) and s.tokens[j].kind != "string" and s.text(j) != ";" and j < i + 200:
                j += 1
            if j < len(s) and s.tokens[j].kind == "string":
                s.add("import", s.value(j), i, j, top=not scopes)
        elif w == "require" and after == "(" and i + 2 < len(s) and s.tokens[i + 2].kind == "string":
            s.add("import", s.value(i + 2), i, i + 3, top=not scopes)
        elif w == "class" and (b := s.next_brace(i)) > 0:
            name = after if s.tokens[i + 1].kind == "word" and after != "extends" else None
            classes.append((s.partner[b], name or ""))
            s.add("type", name, i, s.partner[b], visibility="Public" if exported else "Private", doc=_doc_before(s, t.start), top=not scopes)
        found = None  # name, parenthesis, brace
        if w == "function":
            p = i + 1
            while p < len(s) and s.text(p) != "(":
                p += 1
            if p < len(s) and (b := s.next_brace(s.partner[p] + 1)) > 0:
                name = s.text(p - 1) if p > i + 1 and s.text(p - 1) != "*" else None
                found = (name, p, b, i)
        elif w == "=>" and after == "{" and before == ")":
            p = s.partner[i - 1]
            name = s.text(p - 2) if s.text(p - 1) == "=" else None
            found = (name, p, i + 1, p)
        elif after == "(" and t.kind == "word" and classes and w not in ("if", "for", "while", "switch", "catch", "function", "return") and before != "." and s.text(s.partner[i + 1] + 1) == "{" and (not scopes or scopes[-1][0] > classes[-1][0]):
            found = (w, i + 1, s.partner[i + 1] + 1, i)
        if found:
            name, p, b, head = found
            method = bool(classes) and (not scopes or scopes[-1][0] > classes[-1][0])
            _function(s, name, head, p, b, fn_kind="Method" if method else "Function", visibility="Public" if exported or method else "Private", is_async=s.text(head - 1) == "async", is_test=bool(name and name.startswith("test")) or s.text(head - 2) == "," and any(s.text(k) in ("it", "test") for k in (head - 5, head - 4)), parent=classes[-1][1] if method else None, top=not scopes, **_complexity(s, b, s.partner[b], {"if", "for", "while", "case", "catch"}, {"do"}, {"&&", "||", "??", "?"}))
            names = re.findall(r"[A-Za-z_$][\w$]*", " ".join(s.text(k) for k in range(p + 1, s.partner[p])))
            scopes.append((s.partner[b], ",".join(names), f"{name}@{s.tokens[b].start}"))
        if w == "debugger":
            s.add("debug_calls", "debugger", i, i)
        elif w == "console" and after == "." and s.text(i + 2) in ("log", "debug", "trace") and s.text(i + 3) == "(":
            s.add("debug_calls", f"console.{s.text(i + 2)}", i, s.partner[i + 3])
        elif w == "switch" and after == "(" and s.text(b := s.partner[i + 1] + 1) == "{":
            end = s.partner[b]
            cases, k = [], b + 1
            while k < end:
                if s.text(k) in ("case", "default"):
                    cases.append(k)
                elif s.text(k) in ("(", "[", "{"):
                    k = s.partner[k]
                k += 1
            s.add("switch_sites", None, i, end, has_default=any(s.text(c) == "default" for c in cases), arms=len(cases))
            for c, d in zip(cases, cases[1:]):
                colon = c
                while s.text(colon) != ":":
                    colon += 1
                last = colon
                block = (colon, s.partner[colon + 1]) if s.text(colon + 1) == "{" and s.partner[colon + 1] == d - 1 else (colon, d)
                stmts = s.statements(block[0] + (block[1] != d), block[1])
                quiet = any(s.tokens[c].end <= x.start < s.tokens[d].start and "fallthrough" in re.sub(r"[\s-]", "", x.text.lower()).replace("fallsthrough", "fallthrough") for x in s.comments)
                if stmts and s.text(stmts[-1][0]) not in ("break", "return", "throw", "continue") and not quiet:
                    s.add("case_fallthroughs", None, c, last)
        elif (w == "while" and after == "(" and s.text(i + 2) == "true" and s.text(i + 3) == ")") or (w == "for" and [s.text(k) for k in range(i + 1, i + 5)] == ["(", ";", ";", ")"]):
            b = s.partner[i + 1] + 1
            if s.text(b) == "{" and not _leaves(s, b, {"break", "return", "throw"}, set()) and "process.exit" not in f.text[s.tokens[b].start : s.tokens[s.partner[b]].end]:
                s.add("infinite_loops", None, i, s.partner[b])
        if w in ("if", "while", "for", "catch") and after in ("(", "{"):
            close = s.partner[i + 1] if after == "(" else i
            if s.text(close + 1) == "{" and s.partner[close + 1] == close + 2 and not (w == "catch" and (after == "{" or s.text(i + 2) == "_")):
                s.add("empty_blocks", w, close + 1, close + 2)
            if w in ("if", "while") and after == "(":
                for k in range(i + 2, close):
                    if s.text(k) in ("(", "["):
                        break
                    if s.text(k) in ("=", "+=", "-=", "*=", "/="):
                        s.add("assignment_in_conditions", None, i + 2, close - 1)
                        break
        if w == "{":
            _unreachable(s, i, {"return", "throw", "break", "continue"})
        if w in ("return", "continue", "break") and i + 1 < len(s) and after not in (";", "}") and f.text[t.end : s.tokens[i + 1].start].count("\n") == 1 and (w == "return" or s.tokens[i + 1].kind == "word") and not any(t.end <= c.start < s.tokens[i + 1].start for c in s.comments) and after not in ("case", "default"):
            s.add("asi_hazards", w, i, i + 1)
        if w in ("&", "|", "^") and t.kind == "op":
            left, right = [], []
            k = i - 1
            while k >= 0 and s.text(k) not in ("(", ",", ";", "{", "}", "=", "&&", "||", "return", "?", ":"):
                left.append(s.text(k))
                k = s.partner[k] - 1 if s.text(k) in (")", "]") else k - 1
            k = i + 1
            while k < len(s) and s.text(k) not in (")", ",", ";", "}", "&&", "||", "?", ":"):
                right.append(s.text(k))
                k = s.partner[k] + 1 if s.text(k) in ("(", "[") else k + 1
            compare = {"==", "!=", "===", "!==", "<", ">", "<=", ">="}
            if compare & {*left, *right} or left[-1:] == ["!"] or right[:1] == ["!"]:
                if not (compare & {*left} and "<" in left and ">" in left):
                    s.add("op_precedence_sites", w, i, i)
        if after == "(" and t.kind == "word":
            if before != "." and w in ("eval", "Function", "setTimeout", "setInterval") and (w in ("eval", "Function") or s.tokens[i + 2].kind == "string"):
                s.add("call_sites", w, i, s.partner[i + 1])
            if before == "." and w in ("write", "writeln") and s.text(i - 2) == "document" or before == "." and w == "insertAdjacentHTML":
                s.add("dom_sinks", w, i, s.partner[i + 1])
            if w in JS_BIND and before == ".":
                args = [k for k in range(i + 2, s.partner[i + 1]) if s.tokens[k].kind == "string"]
                s.add("bind_call_sites", w, i, i + 1, arg=s.value(args[0]) if args else None)
            if before == "." and w in JS_LOG_METHODS and s.text(i - 2) in JS_LOG_OBJECTS:
                inside = range(i + 2, s.partner[i + 1])
                strings = [s.tokens[k].text for k in inside if s.tokens[k].kind == "string"]
                template = any(x[0] == "`" and "${" in x for x in strings)
                names = {s.text(k) for k in inside if s.tokens[k].kind == "word" and s.text(k - 1) != "."} | {m for x in strings for m in re.findall(r"\$\{\s*([A-Za-z_$][\w$]*)", x)}
                shaped = template or any(m in x for x in strings for m in PLACEHOLDERS)
                s.add("log_calls", w, i, s.partner[i + 1], placeholder=shaped, args=",".join(sorted(names)), params=scopes[-1][1] if scopes else "")
            begin = i
            while s.text(begin - 1) == ".":
                begin -= 2
            if not scopes and not classes and s.text(begin - 1) in ("", ";", "}", '"', ")") and w not in ("require", "if", "for", "while", "switch", "function", "catch", "import") and s.text(s.partner[i + 1] + 1) in ("", ";"):
                s.add("top_level_calls", w, begin, s.partner[i + 1], is_new=s.text(begin - 1) == "new")
        if before == "." and w in ("innerHTML", "outerHTML") and after in ("=", "+="):
            s.add("dom_sinks", w, i, i)
        if w == "dangerouslySetInnerHTML":
            s.add("dom_sinks", w, i, i)
        if t.kind == "word" and after == "=" and i + 2 < len(s) and before != "." and (s.tokens[i + 2].kind == "string" or s.text(i + 2)[:1].isdigit()):
            s.add("assignments", w, i, i + 2, value=s.value(i + 2), literal="Str" if s.tokens[i + 2].kind == "string" else "Int")
        if t.kind == "word" and scopes and before != "." and after != ":":
            write = after == "=" and not w[:1].isdigit()
            if not w[:1].isdigit():
                s.add("ref", w, i, i, fn=scopes[-1][2], event="write" if write else "read", skip=w.startswith("_"))
    for m in re.finditer(r"/\*\*(?:(?!\*/).)*?@deprecated.*?\*/\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum)\s+(\w+)", f.text, re.S):
        f.add("deprecated_items", m[1], m.start(1), m.end(1))
