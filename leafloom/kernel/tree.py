"""Tree construction of the HTML standard, with scripting off."""

from __future__ import annotations

from leafloom.errors import LimitError
from leafloom.kernel.tokenizer import SPACE, Tokenizer, preprocess
from leafloom.limits import Limits

HTML, SVG, MATH = "html", "svg", "math"


class Node:
    __slots__ = ("attrs", "children", "kind", "name", "ns", "parent", "value")

    def __init__(self, kind: str, name: str | None = None, ns: str | None = None, value: str | None = None, attrs=None):
        self.kind, self.name, self.ns, self.value = kind, name, ns, value
        self.attrs = attrs or []  # (namespace or "", name, value)
        self.parent, self.children = None, []

    def get(self, name: str) -> str | None:
        return next((v for ns, k, v in self.attrs if k == name and not ns), None)

    def index(self, child: Node) -> int:
        return next(i for i in range(len(self.children) - 1, -1, -1) if self.children[i] is child)

    def put(self, child: Node, before: Node | None = None) -> None:
        child.parent = self
        if before is None:
            self.children.append(child)
        else:
            self.children.insert(self.index(before), child)

    def drop(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.parent.index(self)]
            self.parent = None


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


# Fixed values of the HTML standard.
SPECIAL = _set("""address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details
dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input
keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select
source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp""")
SPECIAL_FOREIGN = {MATH: _set("mi mo mn ms mtext annotation-xml"), SVG: _set("foreignObject desc title")}
SCOPE = _set("applet caption html table td th marquee object select template")
IMPLIED = _set("dd dt li optgroup option p rb rp rt rtc")
_BUTTON, _LISTS, _TABLES = _set("button"), _set("ol ul"), _set("html table template")
_IMPLIED_ALL = IMPLIED | _set("caption colgroup tbody td tfoot th thead tr")
_MAY_STAY_OPEN = IMPLIED | _set("tbody td tfoot th thead tr body html")
FORMATTING = _set("a b big code em font i nobr s small strike strong tt u")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
BLOCKS = _set("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu
nav ol p search section summary ul""")
BLOCK_ENDS = (BLOCKS - {"p"}) | _set("button listing pre select")
BREAKOUT = _set("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p
pre ruby s small span strong strike sub sup table tt u ul var""")
# Fixed values of the HTML standard: public identifiers that begin so mean quirks mode.
QUIRKS_PREFIXES = (
    "+//silmaril//dtd html pro v0r11 19970101//",
    "-//as//dtd html 3.0 aswedit + extensions//",
    "-//advasoft ltd//dtd html 3.0 aswedit + extensions//",
    "-//ietf//dtd html 2.0 level 1//",
    "-//ietf//dtd html 2.0 level 2//",
    "-//ietf//dtd html 2.0 strict level 1//",
    "-//ietf//dtd html 2.0 strict level 2//",
    "-//ietf//dtd html 2.0 strict//",
    "-//ietf//dtd html 2.0//",
    "-//ietf//dtd html 2.1e//",
    "-//ietf//dtd html 3.0//",
    "-//ietf//dtd html 3.2 final//",
    "-//ietf//dtd html 3.2//",
    "-//ietf//dtd html 3//",
    "-//ietf//dtd html level 0//",
    "-//ietf//dtd html level 1//",
    "-//ietf//dtd html level 2//",
    "-//ietf//dtd html level 3//",
    "-//ietf//dtd html strict level 0//",
    "-//ietf//dtd html strict level 1//",
    "-//ietf//dtd html strict level 2//",
    "-//ietf//dtd html strict level 3//",
    "-//ietf//dtd html strict//",
    "-//ietf//dtd html//",
    "-//metrius//dtd metrius presentational//",
    "-//microsoft//dtd internet explorer 2.0 html strict//",
    "-//microsoft//dtd internet explorer 2.0 html//",
    "-//microsoft//dtd internet explorer 2.0 tables//",
    "-//microsoft//dtd internet explorer 3.0 html strict//",
    "-//microsoft//dtd internet explorer 3.0 html//",
    "-//microsoft//dtd internet explorer 3.0 tables//",
    "-//netscape comm. corp.//dtd html//",
    "-//netscape comm. corp.//dtd strict html//",
    "-//o'reilly and associates//dtd html 2.0//",
    "-//o'reilly and associates//dtd html extended 1.0//",
    "-//o'reilly and associates//dtd html extended relaxed 1.0//",
    "-//sq//dtd html 2.0 hotmetal + extensions//",
    "-//softquad software//dtd hotmetal pro 6.0::19990601::extensions to html 4.0//",
    "-//softquad//dtd hotmetal pro 4.0::19971010::extensions to html 4.0//",
    "-//spyglass//dtd html 2.0 extended//",
    "-//sun microsystems corp.//dtd hotjava html//",
    "-//sun microsystems corp.//dtd hotjava strict html//",
    "-//w3c//dtd html 3 1995-03-24//",
    "-//w3c//dtd html 3.2 draft//",
    "-//w3c//dtd html 3.2 final//",
    "-//w3c//dtd html 3.2//",
    "-//w3c//dtd html 3.2s draft//",
    "-//w3c//dtd html 4.0 frameset//",
    "-//w3c//dtd html 4.0 transitional//",
    "-//w3c//dtd html experimental 19960712//",
    "-//w3c//dtd html experimental 970421//",
    "-//w3c//dtd w3 html//",
    "-//w3o//dtd w3 html 3.0//",
    "-//webtechs//dtd mozilla html 2.0//",
    "-//webtechs//dtd mozilla html//",
)
QUIRKS_IDS = {"-//w3o//dtd w3 html strict 3.0//en//", "-/w3c/dtd html 4.0 transitional/en", "html"}
SVG_NAMES = {
    n.lower(): n
    for n in """altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix
feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB
feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile
feTurbulence foreignObject glyphRef linearGradient radialGradient textPath""".split()
}
SVG_ATTRS = {
    n.lower(): n
    for n in """attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef
gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight
markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX
pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures
specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles surfaceScale systemLanguage tableValues targetX targetY
textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan""".split()
}
FOREIGN_ATTRS = {f"xlink:{n}": ("xlink", n) for n in _set("actuate arcrole href role show title type")} | {"xml:lang": ("xml", "lang"), "xml:space": ("xml", "space"), "xmlns": ("xmlns", "xmlns"), "xmlns:xlink": ("xmlns", "xlink")}

_ROWS, _CELLS, _BODIES = _set("tr"), _set("td th"), _set("tbody tfoot thead")
_TABLE_PARTS = _set("caption col colgroup tbody td tfoot th thead tr")
_TABLE_TEXT = _set("table tbody template tfoot thead tr")


class Builder:
    def __init__(self, text: str, limits: Limits | None = None, context: tuple[str, str] | None = None, comments: bool = True):
        self.limits = limits or Limits()
        self.problems: list[tuple[str, str, int]] = []  # stage, code, position
        self.truncated = False
        self.tok = Tokenizer(text, lambda code, at: self.problem("tokenizer", code, at))
        self.comments_kept = comments
        self.doc = Node("document")
        self.public = self.system = None
        self.quirks = "no-quirks"
        self.stack: list[Node] = []
        self.paragraphs = 0  # open ones, at most: where there are none, no scope has to be searched for one
        self.formatting: list[Node | None] = []
        self.head = self.form = None
        self.mode, self.original = "initial", None
        self.template_modes: list[str] = []
        self.frameset_ok, self.fostering, self.skip_lf = True, False, False
        self.table_text: list[str] = []
        self.context = None
        self.nodes = 1
        if context:
            self._fragment(*context)

    def _fragment(self, ns: str, name: str) -> None:
        """A parse inside an element of that name."""
        self.context = Node("element", name, ns)
        root = Node("element", "html", HTML)
        self.doc.put(root)
        self.stack.append(root)
        if ns == HTML:
            self.tok.state = {"title": "rcdata", "textarea": "rcdata", "style": "rawtext", "xmp": "rawtext", "iframe": "rawtext", "noembed": "rawtext", "noframes": "rawtext", "script": "script", "plaintext": "plaintext"}.get(name, "data")
            if name == "template":
                self.template_modes.append("in_template")
            if name == "form":
                self.form = self.context
        self.reset_mode()

    def parse(self) -> Node:
        self.tok.run(self)
        return self.doc

    def problem(self, stage: str, code: str, at: int | None = None) -> None:
        if len(self.problems) < self.limits.max_errors:
            self.problems.append((stage, code, self.tok.at if at is None else at))
        else:
            self.truncated = True

    def wrong(self, what: str) -> None:
        self.problem("parser", "unexpected-" + what)

    # -- the stack -----------------------------------------------------------------------------------------------------

    @property
    def current(self) -> Node:
        return self.stack[-1]

    @property
    def adjusted(self) -> Node:
        return self.context if self.context is not None and len(self.stack) == 1 else self.stack[-1]

    def foreign(self) -> bool:
        return bool(self.stack) and self.adjusted.ns != HTML

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.paragraphs += node.name == "p"
        if len(self.stack) > self.limits.max_depth:
            raise LimitError("max_depth", self.limits.max_depth, len(self.stack))

    def pop(self) -> Node:
        node = self.stack.pop()
        self.paragraphs -= node.name == "p"
        if node.name == "option" and node.ns == HTML:
            self.option_done(node)
        return node

    def pop_until(self, names) -> None:
        while self.stack:
            n = self.pop()
            if n.ns == HTML and n.name in names:
                return

    def is_html(self, node: Node, names) -> bool:
        return node.ns == HTML and node.name in names

    def in_scope(self, names, more=frozenset(), only=None) -> bool:
        for n in reversed(self.stack):
            if n.ns == HTML:
                if n.name in names:
                    return True
                if n.name in (only or SCOPE) or n.name in more:
                    return False
            elif not only and n.name in SPECIAL_FOREIGN.get(n.ns, ()):
                return False
        return False

    def in_button_scope(self, names) -> bool:
        return (self.paragraphs > 0 or names != ("p",)) and self.in_scope(names, _BUTTON)

    def in_list_scope(self, names) -> bool:
        return self.in_scope(names, _LISTS)

    def in_table_scope(self, names) -> bool:
        return self.in_scope(names, only=_TABLES)

    def on_stack(self, name: str) -> bool:
        return any(n.ns == HTML and n.name == name for n in self.stack)

    def implied(self, but: str | None = None, all_: bool = False) -> None:
        names = _IMPLIED_ALL if all_ else IMPLIED
        while self.stack and self.current.ns == HTML and self.current.name in names and self.current.name != but:
            self.pop()

    def close_p(self) -> None:
        self.implied("p")
        if not self.is_html(self.current, ("p",)):
            self.wrong("end-tag")
        self.pop_until(("p",))

    def clear_to(self, names) -> None:
        while not (self.current.ns == HTML and (self.current.name in names or self.current.name in ("template", "html"))):
            self.pop()

    # -- insertion -----------------------------------------------------------------------------------------------------

    def place(self, target: Node | None = None) -> tuple[Node, Node | None]:
        """Parent, and the child to insert before (None: at the end)."""
        target = target or self.current
        if self.fostering and target.ns == HTML and target.name in ("table", "tbody", "tfoot", "thead", "tr"):
            for i in range(len(self.stack) - 1, -1, -1):
                n = self.stack[i]
                if n.ns == HTML and n.name == "template":
                    return n, None
                if n.ns == HTML and n.name == "table":
                    return (n.parent, n) if n.parent is not None else (self.stack[i - 1], None)
            return self.stack[0], None
        return target, None

    def count(self) -> None:
        self.nodes += 1
        if self.nodes > self.limits.max_nodes:
            raise LimitError("max_nodes", self.limits.max_nodes, self.nodes)

    def insert(self, name: str, attrs, ns: str = HTML) -> Node:
        node = self.make(name, attrs, ns)
        parent, before = self.place()
        parent.put(node, before)
        self.push(node)
        return node

    def make(self, name: str, attrs, ns: str = HTML) -> Node:
        self.count()
        return Node("element", name, ns, attrs=[a if len(a) == 3 else ("", a[0], a[1]) for a in attrs])

    def insert_text(self, text: str) -> None:
        if not text:
            return
        parent, before = self.place()
        if parent.kind == "document":
            return
        last = parent.children[parent.index(before) - 1] if before is not None and parent.index(before) else (parent.children[-1] if before is None and parent.children else None)
        if last is not None and last.kind == "text":
            last.value += text
        else:
            self.count()
            parent.put(Node("text", value=text), before)

    def other(self, kind: str, value: str, parent: Node | None = None) -> None:
        if kind == "comment" and not self.comments_kept:
            # what would have been two text nodes stays two
            self._gap(parent)
            return
        self.count()
        p, before = (parent, None) if parent is not None else self.place()
        p.put(Node(kind, value=value), before)

    def _gap(self, parent: Node | None) -> None:
        p, before = (parent, None) if parent is not None else self.place()
        p.put(Node("gap"), before)

    # -- active formatting elements --------------------------------------------------------------------------------------

    def format(self, node: Node) -> None:
        same, key = 0, (node.name, sorted(node.attrs))
        for i in range(len(self.formatting) - 1, -1, -1):
            f = self.formatting[i]
            if f is None:
                break
            if (f.name, sorted(f.attrs)) == key:
                same += 1
                if same == 3:
                    del self.formatting[i]
                    break
        self.formatting.append(node)

    def reconstruct(self) -> None:
        f = self.formatting
        if not f or f[-1] is None or self._open(f[-1]):
            return
        i = len(f) - 1
        while i > 0 and f[i - 1] is not None and not self._open(f[i - 1]):
            i -= 1
        for k in range(i, len(f)):
            f[k] = self.insert(f[k].name, f[k].attrs)

    def _open(self, node: Node) -> bool:
        return any(n is node for n in reversed(self.stack))

    def clear_formatting(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def adopt(self, name: str) -> None:
        """The adoption agency algorithm."""
        cur = self.current
        if cur.ns == HTML and cur.name == name and not any(f is cur for f in self.formatting):
            self.pop()
            return
        for _ in range(8):
            el = None
            for f in reversed(self.formatting):
                if f is None:
                    break
                if f.name == name:
                    el = f
                    break
            if el is None:
                self.any_end(name)
                return
            at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i] is el), None)
            if at is None:
                self.wrong("end-tag")
                self._unformat(el)
                return
            if not self._node_in_scope(el):
                self.wrong("end-tag")
                return
            if el is not self.current:
                self.wrong("end-tag")
            far = next((n for n in self.stack[at + 1 :] if self.special(n)), None)
            if far is None:
                while self.pop() is not el:
                    pass
                self._unformat(el)
                return
            above = self.stack[at - 1]
            mark = next(i for i, f in enumerate(self.formatting) if f is el)
            i = next(k for k, n in enumerate(self.stack) if n is far)
            last, inner = far, 0
            while True:
                inner += 1
                i -= 1
                node = self.stack[i]
                if node is el:
                    break
                k = next((x for x, f in enumerate(self.formatting) if f is node), None)
                if inner > 3 and k is not None:
                    del self.formatting[k]
                    if k < mark:
                        mark -= 1
                    k = None
                if k is None:
                    del self.stack[i]
                    continue
                new = self.make(node.name, node.attrs)
                self.formatting[k] = self.stack[i] = new
                if last is far:
                    mark = k + 1
                last.drop()
                new.put(last)
                last = new
            last.drop()
            keep = self.fostering
            self.fostering = True
            parent, before = self.place(above)
            self.fostering = keep
            parent.put(last, before)
            new = self.make(el.name, el.attrs)
            for c in far.children:
                c.parent = new
            new.children, far.children = far.children, []
            far.put(new)
            k = next(x for x, f in enumerate(self.formatting) if f is el)
            del self.formatting[k]
            self.formatting.insert(mark - 1 if k < mark else mark, new)
            del self.stack[next(x for x, n in enumerate(self.stack) if n is el)]
            self.stack.insert(next(x for x, n in enumerate(self.stack) if n is far) + 1, new)

    def _unformat(self, el: Node) -> None:
        self.formatting = [f for f in self.formatting if f is not el]

    def _node_in_scope(self, el: Node) -> bool:
        for n in reversed(self.stack):
            if n is el:
                return True
            if n.ns == HTML and n.name in SCOPE or n.ns != HTML and n.name in SPECIAL_FOREIGN[n.ns]:
                return False
        return False

    def special(self, n: Node) -> bool:
        return n.name in SPECIAL if n.ns == HTML else n.name in SPECIAL_FOREIGN[n.ns]

    def any_end(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            n = self.stack[i]
            if n.ns == HTML and n.name == name:
                self.implied(name)
                if n is not self.current:
                    self.wrong("end-tag")
                while self.pop() is not n:
                    pass
                return
            if self.special(n):
                self.wrong("end-tag")
                return

    # -- selected content ------------------------------------------------------------------------------------------------

    def option_done(self, option: Node) -> None:
        """Copies the chosen option into the select's first <selectedcontent>, which stands in a button."""
        select, n = None, option.parent
        while n is not None:
            if n.ns == HTML and n.name == "selectedcontent":
                return
            if n.ns == HTML and n.name == "select":
                select = n
                break
            n = n.parent
        if select is None or select.get("multiple") is not None:
            return
        options, target, todo = [], None, list(reversed(select.children))
        while todo:
            n = todo.pop()
            if n.ns == HTML and n.name == "option":
                options.append(n)
            if n.ns == HTML and n.name == "selectedcontent" and target is None:
                target = n
            if not (n.ns == HTML and n.name in ("select", "selectedcontent")):
                todo.extend(reversed(n.children))
        if target is None or not options:
            return
        chosen = [o for o in options if o.get("selected") is not None]
        first = next((o for o in options if o.get("disabled") is None), options[0])
        if option is (chosen[-1] if chosen else first):
            for c in target.children:
                c.parent = None
            target.children = []
            self._copy(option, target)

    def _copy(self, source: Node, target: Node) -> None:
        todo = [(source, target)]
        while todo:
            s, t = todo.pop()
            for c in s.children:
                self.count()
                n = Node(c.kind, c.name, c.ns, c.value, list(c.attrs))
                t.put(n)
                todo.append((c, n))

    # -- tokens ----------------------------------------------------------------------------------------------------------

    def text(self, s: str) -> None:
        if self.skip_lf:
            self.skip_lf = False
            if s[0] == "\n":
                s = s[1:]
                if not s:
                    return
        if self.foreign() and not self.html_point(self.adjusted) and not self.math_point(self.adjusted):
            if "\0" in s:
                self.wrong("null")
                s = s.replace("\0", "�")
            self.insert_text(s)
            if s.strip(SPACE):
                if s.strip(SPACE + "�"):
                    self.frameset_ok = False
            return
        getattr(self, "text_" + self.mode)(s)

    def comment(self, s: str) -> None:
        self._aside("comment", s)

    def instruction(self, s: str) -> None:
        self._aside("processing_instruction", s)

    def _aside(self, kind: str, s: str) -> None:
        self.skip_lf = False
        if self.mode == "in_table_text":
            self.flush_table_text()
        if self.mode in ("initial", "before_html", "after_after_body", "after_after_frameset"):
            self.other(kind, s, self.doc)
        elif self.mode == "after_body":
            self.other(kind, s, self.stack[0])
        else:
            self.other(kind, s)

    def doctype(self, name, public, system, quirks) -> None:
        self.skip_lf = False
        if self.mode == "in_table_text":
            self.flush_table_text()
        if self.mode != "initial" or self.foreign():
            self.wrong("doctype")
            return
        p, s = (public or "").lower(), (system or "").lower()
        if name != "html" or public is not None or (system is not None and s != "about:legacy-compat"):
            self.wrong("doctype")
        self.count()
        self.doc.put(Node("doctype", name))
        self.public, self.system = public, system
        if quirks or name != "html" or p in QUIRKS_IDS or p.startswith(QUIRKS_PREFIXES) or s == "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd" or (system is None and p.startswith(("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//"))):
            self.quirks = "quirks"
        elif p.startswith(("-//w3c//dtd xhtml 1.0 frameset//", "-//w3c//dtd xhtml 1.0 transitional//")) or p.startswith(("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//")):
            self.quirks = "limited-quirks"
        self.mode = "before_html"

    def start_tag(self, name: str, attrs, void: bool) -> None:
        self.skip_lf = False
        self.void_ok, self.self_closing = False, void
        if self._foreign_start(name):
            self.start_foreign(name, attrs, void)
        else:
            getattr(self, "start_" + self.mode)(name, attrs)
        if void and not self.void_ok:
            self.problem("parser", "non-void-self-closing-tag")

    def end_tag(self, name: str) -> None:
        self.skip_lf = False
        if self.foreign():
            self.end_foreign(name)
        else:
            getattr(self, "end_" + self.mode)(name)

    def eof(self) -> None:
        getattr(self, "eof_" + self.mode, self.eof_in_body)()

    # -- foreign content -------------------------------------------------------------------------------------------------

    def _foreign_start(self, name: str) -> bool:
        if not self.foreign():
            return False
        n = self.adjusted
        if n.ns == MATH and n.name in ("mi", "mo", "mn", "ms", "mtext") and name not in ("mglyph", "malignmark"):
            return False
        if n.ns == MATH and n.name == "annotation-xml" and name == "svg":
            return False
        return not self.html_point(n)

    @staticmethod
    def html_point(n: Node) -> bool:
        if n.ns == MATH and n.name == "annotation-xml":
            return (n.get("encoding") or "").lower() in ("text/html", "application/xhtml+xml")
        return n.ns == SVG and n.name in ("foreignObject", "desc", "title")

    @staticmethod
    def math_point(n: Node) -> bool:
        return n.ns == MATH and n.name in ("mi", "mo", "mn", "ms", "mtext")

    def start_foreign(self, name: str, attrs, void: bool) -> None:
        if name in BREAKOUT or (name == "font" and any(k in ("color", "face", "size") for k, _ in attrs)):
            self.wrong("start-tag")
            while not (self.current.ns == HTML or self.math_point(self.current) or self.html_point(self.current)):
                self.pop()
            getattr(self, "start_" + self.mode)(name, attrs)
            return
        ns = self.adjusted.ns
        self.insert(*self.adjust(name, attrs, ns), ns)
        if void:
            self.void_ok = True
            self.pop()

    @staticmethod
    def adjust(name: str, attrs, ns: str):
        if ns == SVG:
            name = SVG_NAMES.get(name, name)
        out = []
        for k, v in attrs:
            if k in FOREIGN_ATTRS:
                out.append((*FOREIGN_ATTRS[k], v))
            elif ns == SVG:
                out.append(("", SVG_ATTRS.get(k, k), v))
            else:
                out.append(("", "definitionURL" if k == "definitionurl" else k, v))
        return name, out

    def end_foreign(self, name: str) -> None:
        if name in ("br", "p"):
            self.wrong("end-tag")
            while not (self.current.ns == HTML or self.math_point(self.current) or self.html_point(self.current)):
                self.pop()
            getattr(self, "end_" + self.mode)(name)
            return
        i = len(self.stack) - 1
        n = self.stack[i]
        if n.name.lower() != name:
            self.wrong("end-tag")
        while i > 0:
            if n.name.lower() == name:
                while self.pop() is not n:
                    pass
                return
            i -= 1
            n = self.stack[i]
            if n.ns == HTML:
                getattr(self, "end_" + self.mode)(name)
                return

    # -- modes before the body ---------------------------------------------------------------------------------------------

    def text_initial(self, s: str) -> None:
        s = s.lstrip(SPACE)
        if s:
            self._no_doctype()
            self.text(s)

    def _no_doctype(self) -> None:
        self.wrong("start-tag" if self.mode == "initial" else "eof")
        self.quirks = "quirks"
        self.mode = "before_html"

    def start_initial(self, name, attrs) -> None:
        self._no_doctype()
        self.start_before_html(name, attrs)

    def end_initial(self, name) -> None:
        self._no_doctype()
        self.end_before_html(name)

    def eof_initial(self) -> None:
        self._no_doctype()
        self.eof_before_html()

    def _html(self, attrs=()) -> None:
        node = self.make("html", attrs)
        self.doc.put(node)
        self.push(node)
        self.mode = "before_head"

    def text_before_html(self, s: str) -> None:
        s = s.lstrip(SPACE)
        if s:
            self._html()
            self.text(s)

    def start_before_html(self, name, attrs) -> None:
        if name == "html":
            self._html(attrs)
        else:
            self._html()
            self.start_before_head(name, attrs)

    def end_before_html(self, name) -> None:
        if name in ("head", "body", "html", "br"):
            self._html()
            self.end_before_head(name)
        else:
            self.wrong("end-tag")

    def eof_before_html(self) -> None:
        self._html()
        self.eof_before_head()

    def _head(self, attrs=()) -> None:
        self.head = self.insert("head", attrs)
        self.mode = "in_head"

    def text_before_head(self, s: str) -> None:
        s = s.lstrip(SPACE)
        if s:
            self._head()
            self.text(s)

    def start_before_head(self, name, attrs) -> None:
        if name == "html":
            self.start_in_body(name, attrs)
        elif name == "head":
            self._head(attrs)
        else:
            self._head()
            self.start_in_head(name, attrs)

    def end_before_head(self, name) -> None:
        if name in ("head", "body", "html", "br"):
            self._head()
            self.end_in_head(name)
        else:
            self.wrong("end-tag")

    def eof_before_head(self) -> None:
        self._head()
        self.eof_in_head()

    def _split(self, s: str) -> tuple[str, str]:
        rest = s.lstrip(SPACE)
        return s[: len(s) - len(rest)], rest

    def text_in_head(self, s: str) -> None:
        space, s = self._split(s)
        self.insert_text(space)
        if s:
            self._leave_head()
            self.text(s)

    def _leave_head(self) -> None:
        self.pop()
        self.mode = "after_head"

    def raw(self, name, attrs, state: str) -> None:
        self.insert(name, attrs)
        self.tok.state = state
        self.original, self.mode = self.mode, "text"

    def start_in_head(self, name, attrs) -> None:
        if name == "html":
            self.start_in_body(name, attrs)
        elif name in ("base", "basefont", "bgsound", "link", "meta"):
            self.insert(name, attrs)
            self.pop()
            self.void_ok = True
        elif name == "title":
            self.raw(name, attrs, "rcdata")
        elif name in ("noframes", "style"):
            self.raw(name, attrs, "rawtext")
        elif name == "noscript":
            self.insert(name, attrs)
            self.mode = "in_head_noscript"
        elif name == "script":
            self.raw(name, attrs, "script")
        elif name == "template":
            self.insert(name, attrs)
            self.formatting.append(None)
            self.frameset_ok = False
            self.mode = "in_template"
            self.template_modes.append("in_template")
        elif name == "head":
            self.wrong("start-tag")
        else:
            self._leave_head()
            self.start_after_head(name, attrs)

    def end_in_head(self, name) -> None:
        if name == "head":
            self._leave_head()
        elif name in ("body", "html", "br"):
            self._leave_head()
            self.end_after_head(name)
        elif name == "template":
            self.end_template()
        else:
            self.wrong("end-tag")

    def end_template(self) -> None:
        if not self.on_stack("template"):
            self.wrong("end-tag")
            return
        self.implied(all_=True)
        if not self.is_html(self.current, ("template",)):
            self.wrong("end-tag")
        self.pop_until(("template",))
        self.clear_formatting()
        self.template_modes.pop()
        self.reset_mode()

    def eof_in_head(self) -> None:
        self._leave_head()
        self.eof_after_head()

    def text_in_head_noscript(self, s: str) -> None:
        space, s = self._split(s)
        self.insert_text(space)
        if s:
            self.wrong("character")
            self.pop()
            self.mode = "in_head"
            self.text(s)

    def start_in_head_noscript(self, name, attrs) -> None:
        if name == "html":
            self.start_in_body(name, attrs)
        elif name in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
            self.start_in_head(name, attrs)
        elif name in ("head", "noscript"):
            self.wrong("start-tag")
        else:
            self.wrong("start-tag")
            self.pop()
            self.mode = "in_head"
            self.start_in_head(name, attrs)

    def end_in_head_noscript(self, name) -> None:
        if name == "noscript":
            self.pop()
            self.mode = "in_head"
        elif name == "br":
            self.wrong("end-tag")
            self.pop()
            self.mode = "in_head"
            self.end_in_head(name)
        else:
            self.wrong("end-tag")

    def eof_in_head_noscript(self) -> None:
        self.wrong("eof")
        self.pop()
        self.mode = "in_head"
        self.eof_in_head()

    def _body(self, attrs=()) -> None:
        self.insert("body", attrs)
        self.mode = "in_body"

    def text_after_head(self, s: str) -> None:
        space, s = self._split(s)
        self.insert_text(space)
        if s:
            self._body()
            self.text(s)

    def start_after_head(self, name, attrs) -> None:
        if name == "html":
            self.start_in_body(name, attrs)
        elif name == "body":
            self.frameset_ok = False
            self._body(attrs)
        elif name == "frameset":
            self.insert(name, attrs)
            self.mode = "in_frameset"
        elif name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
            self.wrong("start-tag")
            self.push(self.head)
            head = self.head
            self.start_in_head(name, attrs)
            self.stack = [n for n in self.stack if n is not head]
        elif name == "head":
            self.wrong("start-tag")
        else:
            self._body()
            self.start_in_body(name, attrs)

    def end_after_head(self, name) -> None:
        if name == "template":
            self.end_template()
        elif name in ("body", "html", "br"):
            self._body()
            self.end_in_body(name)
        else:
            self.wrong("end-tag")

    def eof_after_head(self) -> None:
        self._body()
        self.eof_in_body()

    # -- in body -------------------------------------------------------------------------------------------------------

    def text_in_body(self, s: str) -> None:
        if "\0" in s:
            self.wrong("null")
            s = s.replace("\0", "")
            if not s:
                return
        self.reconstruct()
        self.insert_text(s)
        if self.frameset_ok and s.strip(SPACE):
            self.frameset_ok = False

    def start_in_body(self, name, attrs) -> None:
        if (f := _BODY.get(name)) is not None:
            f(self, name, attrs)
        else:
            self.reconstruct()
            self.insert(name, attrs)

    def b_html(self, name, attrs) -> None:
        self.wrong("start-tag")
        if not self.on_stack("template"):
            self._merge(self.stack[0], attrs)

    @staticmethod
    def _merge(node: Node, attrs) -> None:
        have = {k for ns, k, _ in node.attrs if not ns}
        node.attrs += [("", k, v) for k, v in attrs if k not in have]

    def b_body(self, name, attrs) -> None:
        self.wrong("start-tag")
        if len(self.stack) > 1 and self.is_html(self.stack[1], ("body",)) and not self.on_stack("template"):
            self.frameset_ok = False
            self._merge(self.stack[1], attrs)

    def b_frameset(self, name, attrs) -> None:
        self.wrong("start-tag")
        if len(self.stack) > 1 and self.is_html(self.stack[1], ("body",)) and self.frameset_ok:
            self.stack[1].drop()
            while len(self.stack) > 1:
                self.pop()
            self.insert(name, attrs)
            self.mode = "in_frameset"

    def b_block(self, name, attrs) -> None:
        if self.in_button_scope(("p",)):
            self.close_p()
        self.insert(name, attrs)

    def b_heading(self, name, attrs) -> None:
        if self.in_button_scope(("p",)):
            self.close_p()
        if self.is_html(self.current, HEADINGS):
            self.wrong("start-tag")
            self.pop()
        self.insert(name, attrs)

    def b_pre(self, name, attrs) -> None:
        self.b_block(name, attrs)
        self.skip_lf, self.frameset_ok = True, False

    def b_form(self, name, attrs) -> None:
        template = self.on_stack("template")
        if self.form is not None and not template:
            self.wrong("start-tag")
            return
        if self.in_button_scope(("p",)):
            self.close_p()
        node = self.insert(name, attrs)
        if not template:
            self.form = node

    def b_item(self, name, attrs) -> None:
        self.frameset_ok = False
        ends = ("li",) if name == "li" else ("dd", "dt")
        for n in reversed(self.stack):
            if self.is_html(n, ends):
                self.implied(n.name)
                if self.current.name != n.name:
                    self.wrong("start-tag")
                self.pop_until((n.name,))
                break
            if self.special(n) and not self.is_html(n, ("address", "div", "p")):
                break
        self.b_block(name, attrs)

    def b_plaintext(self, name, attrs) -> None:
        self.b_block(name, attrs)
        self.tok.state = "plaintext"

    def b_button(self, name, attrs) -> None:
        if self.in_scope(("button",)):
            self.wrong("start-tag")
            self.implied()
            self.pop_until(("button",))
        self.reconstruct()
        self.insert(name, attrs)
        self.frameset_ok = False

    def b_a(self, name, attrs) -> None:
        for f in reversed(self.formatting):
            if f is None:
                break
            if f.name == "a":
                self.wrong("start-tag")
                self.adopt("a")
                self._unformat(f)
                self.stack = [n for n in self.stack if n is not f]
                break
        self.b_format(name, attrs)

    def b_format(self, name, attrs) -> None:
        self.reconstruct()
        self.format(self.insert(name, attrs))

    def b_nobr(self, name, attrs) -> None:
        self.reconstruct()
        if self.in_scope(("nobr",)):
            self.wrong("start-tag")
            self.adopt("nobr")
            self.reconstruct()
        self.format(self.insert(name, attrs))

    def b_marked(self, name, attrs) -> None:
        self.reconstruct()
        self.insert(name, attrs)
        self.formatting.append(None)
        self.frameset_ok = False

    def b_table(self, name, attrs) -> None:
        if self.quirks != "quirks" and self.in_button_scope(("p",)):
            self.close_p()
        self.insert(name, attrs)
        self.frameset_ok = False
        self.mode = "in_table"

    def b_void(self, name, attrs) -> None:
        self.reconstruct()
        self.insert(name, attrs)
        self.pop()
        self.void_ok = True
        self.frameset_ok = False

    def b_input(self, name, attrs) -> None:
        if self.context is not None and self.is_html(self.context, ("select",)) and not self.in_scope(("select",)):
            self.wrong("start-tag")
            return
        if self.in_scope(("select",)):
            self.wrong("start-tag")
            self.pop_until(("select",))
        keep = self.frameset_ok
        self.b_void(name, attrs)
        if next((v for k, v in attrs if k == "type"), "").lower() == "hidden":
            self.frameset_ok = keep

    def b_param(self, name, attrs) -> None:
        self.insert(name, attrs)
        self.pop()
        self.void_ok = True

    def b_hr(self, name, attrs) -> None:
        if self.in_button_scope(("p",)):
            self.close_p()
        if self.in_scope(("select",)):
            self.implied()
            if self.in_scope(("option",)) or self.in_scope(("optgroup",)):
                self.wrong("start-tag")
        self.insert(name, attrs)
        self.pop()
        self.void_ok = True
        self.frameset_ok = False

    def b_image(self, name, attrs) -> None:
        self.wrong("start-tag")
        self.start_in_body("img", attrs)

    def b_textarea(self, name, attrs) -> None:
        self.raw(name, attrs, "rcdata")
        self.skip_lf, self.frameset_ok = True, False

    def b_xmp(self, name, attrs) -> None:
        if self.in_button_scope(("p",)):
            self.close_p()
        self.reconstruct()
        self.frameset_ok = False
        self.raw(name, attrs, "rawtext")

    def b_iframe(self, name, attrs) -> None:
        self.frameset_ok = False
        self.raw(name, attrs, "rawtext")

    def b_noembed(self, name, attrs) -> None:
        self.raw(name, attrs, "rawtext")

    def b_select(self, name, attrs) -> None:
        if self.context is not None and self.is_html(self.context, ("select",)) and not self.in_scope(("select",)):
            self.wrong("start-tag")
            return
        if self.in_scope(("select",)):
            self.wrong("start-tag")
            self.pop_until(("select",))
            return
        self.reconstruct()
        self.insert(name, attrs)
        self.frameset_ok = False

    def b_option(self, name, attrs) -> None:
        if self.in_scope(("select",)):
            self.implied("optgroup")
            if self.in_scope(("option",)):
                self.wrong("start-tag")
        elif self.is_html(self.current, ("option",)):
            self.pop()
        self.reconstruct()
        self.insert(name, attrs)

    def b_optgroup(self, name, attrs) -> None:
        if self.in_scope(("select",)):
            self.implied()
            if self.in_scope(("option",)) or self.in_scope(("optgroup",)):
                self.wrong("start-tag")
        elif self.is_html(self.current, ("option",)):
            self.pop()
        self.reconstruct()
        self.insert(name, attrs)

    def b_ruby(self, name, attrs) -> None:
        if self.in_scope(("ruby",)):
            self.implied("rtc" if name in ("rp", "rt") else None)
            if not self.is_html(self.current, ("ruby", "rtc")):
                self.wrong("start-tag")
        self.insert(name, attrs)

    def b_foreign(self, name, attrs) -> None:
        self.reconstruct()
        self.insert(*self.adjust(name, attrs, name), name)
        if self.self_closing:
            self.void_ok = True
            self.pop()

    def b_ignored(self, name, attrs) -> None:
        self.wrong("start-tag")

    def b_head(self, name, attrs) -> None:
        self.start_in_head(name, attrs)

    def end_in_body(self, name) -> None:
        if name == "template":
            self.end_template()
        elif name in ("body", "html"):
            if not self.in_scope(("body",)):
                self.wrong("end-tag")
                return
            if any(n.ns != HTML or n.name not in _MAY_STAY_OPEN for n in self.stack):
                self.wrong("end-tag")
            self.mode = "after_body"
            if name == "html":
                self.end_after_body(name)
        elif name in BLOCK_ENDS:
            if not self.in_scope((name,)):
                self.wrong("end-tag")
                return
            self.implied()
            if not self.is_html(self.current, (name,)):
                self.wrong("end-tag")
            self.pop_until((name,))
        elif name == "form":
            self.end_form()
        elif name == "p":
            if not self.in_button_scope(("p",)):
                self.wrong("end-tag")
                self.insert("p", [])
            self.close_p()
        elif name in ("li", "dd", "dt"):
            if not (self.in_list_scope if name == "li" else self.in_scope)((name,)):
                self.wrong("end-tag")
                return
            self.implied(name)
            if not self.is_html(self.current, (name,)):
                self.wrong("end-tag")
            self.pop_until((name,))
        elif name in HEADINGS:
            if not self.in_scope(HEADINGS):
                self.wrong("end-tag")
                return
            self.implied()
            if not self.is_html(self.current, (name,)):
                self.wrong("end-tag")
            self.pop_until(HEADINGS)
        elif name in FORMATTING:
            self.adopt(name)
        elif name in ("applet", "marquee", "object"):
            if not self.in_scope((name,)):
                self.wrong("end-tag")
                return
            self.implied()
            if not self.is_html(self.current, (name,)):
                self.wrong("end-tag")
            self.pop_until((name,))
            self.clear_formatting()
        elif name == "br":
            self.wrong("end-tag")
            self.b_void("br", [])
        else:
            self.any_end(name)

    def end_form(self) -> None:
        if not self.on_stack("template"):
            node, self.form = self.form, None
            if node is None or not self._node_in_scope(node):
                self.wrong("end-tag")
                return
            self.implied()
            if self.current is not node:
                self.wrong("end-tag")
            self.stack = [n for n in self.stack if n is not node]
            return
        if not self.in_scope(("form",)):
            self.wrong("end-tag")
            return
        self.implied()
        if not self.is_html(self.current, ("form",)):
            self.wrong("end-tag")
        self.pop_until(("form",))

    def eof_in_body(self) -> None:
        if self.template_modes:
            self.eof_in_template()
            return
        if any(n.ns != HTML or n.name not in _MAY_STAY_OPEN for n in self.stack):
            self.wrong("eof")
        self._stop()

    def _stop(self) -> None:
        while self.stack:
            self.pop()

    # -- text ----------------------------------------------------------------------------------------------------------

    def text_text(self, s: str) -> None:
        self.insert_text(s)

    def end_text(self, name) -> None:
        self.pop()
        self.mode = self.original

    def eof_text(self) -> None:
        self.wrong("eof")
        self.pop()
        self.mode = self.original
        self.eof()

    # -- tables --------------------------------------------------------------------------------------------------------

    def text_in_table(self, s: str) -> None:
        if self.current.ns == HTML and self.current.name in _TABLE_TEXT:
            self.table_text = []
            self.original, self.mode = self.mode, "in_table_text"
            self.text_in_table_text(s)
        else:
            self.fostered_text(s)

    def fostered_text(self, s: str) -> None:
        self.wrong("character")
        self.fostering = True
        self.text_in_body(s)
        self.fostering = False

    def text_in_table_text(self, s: str) -> None:
        if "\0" in s:
            self.wrong("null")
            s = s.replace("\0", "")
        self.table_text.append(s)

    def flush_table_text(self) -> None:
        s = "".join(self.table_text)
        self.mode = self.original
        if s.strip(SPACE):
            self.fostered_text(s)
        else:
            self.insert_text(s)

    def start_in_table_text(self, name, attrs) -> None:
        self.flush_table_text()
        self.start_tag(name, attrs, False)

    def end_in_table_text(self, name) -> None:
        self.flush_table_text()
        self.end_tag(name)

    def eof_in_table_text(self) -> None:
        self.flush_table_text()
        self.eof()

    def start_in_table(self, name, attrs) -> None:
        if name == "caption":
            self.clear_to(("table",))
            self.formatting.append(None)
            self.insert(name, attrs)
            self.mode = "in_caption"
        elif name == "colgroup":
            self.clear_to(("table",))
            self.insert(name, attrs)
            self.mode = "in_column_group"
        elif name == "col":
            self.clear_to(("table",))
            self.insert("colgroup", [])
            self.mode = "in_column_group"
            self.start_in_column_group(name, attrs)
        elif name in _BODIES:
            self.clear_to(("table",))
            self.insert(name, attrs)
            self.mode = "in_table_body"
        elif name in _CELLS or name == "tr":
            self.clear_to(("table",))
            self.insert("tbody", [])
            self.mode = "in_table_body"
            self.start_in_table_body(name, attrs)
        elif name == "table":
            self.wrong("start-tag")
            if self.in_table_scope(("table",)):
                self.pop_until(("table",))
                self.reset_mode()
                self.start_tag(name, attrs, False)
        elif name in ("style", "script", "template"):
            self.start_in_head(name, attrs)
        elif name == "input" and next((v for k, v in attrs if k == "type"), "").lower() == "hidden":
            self.wrong("start-tag")
            self.insert(name, attrs)
            self.pop()
            self.void_ok = True
        elif name == "form":
            self.wrong("start-tag")
            if self.form is None and not self.on_stack("template"):
                self.form = self.insert(name, attrs)
                self.pop()
        else:
            self.wrong("start-tag")
            self.fostering = True
            self.start_in_body(name, attrs)
            self.fostering = False

    def end_in_table(self, name) -> None:
        if name == "table":
            if not self.in_table_scope(("table",)):
                self.wrong("end-tag")
                return
            self.pop_until(("table",))
            self.reset_mode()
        elif name in _TABLE_PARTS or name in ("body", "html"):
            self.wrong("end-tag")
        elif name == "template":
            self.end_template()
        else:
            self.wrong("end-tag")
            self.fostering = True
            self.end_in_body(name)
            self.fostering = False

    def text_in_caption(self, s: str) -> None:
        self.text_in_body(s)

    def _end_caption(self) -> bool:
        if not self.in_table_scope(("caption",)):
            self.wrong("end-tag")
            return False
        self.implied()
        if not self.is_html(self.current, ("caption",)):
            self.wrong("end-tag")
        self.pop_until(("caption",))
        self.clear_formatting()
        self.mode = "in_table"
        return True

    def start_in_caption(self, name, attrs) -> None:
        if name in _TABLE_PARTS:
            if self._end_caption():
                self.start_in_table(name, attrs)
        else:
            self.start_in_body(name, attrs)

    def end_in_caption(self, name) -> None:
        if name == "caption":
            self._end_caption()
        elif name == "table":
            if self._end_caption():
                self.end_in_table(name)
        elif name in _TABLE_PARTS or name in ("body", "html"):
            self.wrong("end-tag")
        else:
            self.end_in_body(name)

    def text_in_column_group(self, s: str) -> None:
        space, s = self._split(s)
        self.insert_text(space)
        if s and self._end_colgroup():
            self.text(s)

    def _end_colgroup(self) -> bool:
        if not self.is_html(self.current, ("colgroup",)):
            self.wrong("end-tag")
            return False
        self.pop()
        self.mode = "in_table"
        return True

    def start_in_column_group(self, name, attrs) -> None:
        if name == "html":
            self.start_in_body(name, attrs)
        elif name == "col":
            self.insert(name, attrs)
            self.pop()
            self.void_ok = True
        elif name == "template":
            self.start_in_head(name, attrs)
        elif self._end_colgroup():
            self.start_tag(name, attrs, False)

    def end_in_column_group(self, name) -> None:
        if name == "colgroup":
            self._end_colgroup()
        elif name == "col":
            self.wrong("end-tag")
        elif name == "template":
            self.end_template()
        elif self._end_colgroup():
            self.end_in_table(name)

    def text_in_table_body(self, s: str) -> None:
        self.text_in_table(s)

    def start_in_table_body(self, name, attrs) -> None:
        if name == "tr":
            self.clear_to(("tbody", "tfoot", "thead"))
            self.insert(name, attrs)
            self.mode = "in_row"
        elif name in _CELLS:
            self.wrong("start-tag")
            self.clear_to(("tbody", "tfoot", "thead"))
            self.insert("tr", [])
            self.mode = "in_row"
            self.start_in_row(name, attrs)
        elif name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead"):
            if self._end_body():
                self.start_in_table(name, attrs)
        else:
            self.start_in_table(name, attrs)

    def _end_body(self) -> bool:
        if not self.in_table_scope(_BODIES):
            self.wrong("end-tag")
            return False
        self.clear_to(("tbody", "tfoot", "thead"))
        self.pop()
        self.mode = "in_table"
        return True

    def end_in_table_body(self, name) -> None:
        if name in _BODIES:
            if not self.in_table_scope((name,)):
                self.wrong("end-tag")
            else:
                self._end_body()
        elif name == "table":
            if self._end_body():
                self.end_in_table(name)
        elif name in _TABLE_PARTS or name in ("body", "html"):
            self.wrong("end-tag")
        else:
            self.end_in_table(name)

    def text_in_row(self, s: str) -> None:
        self.text_in_table(s)

    def _end_row(self) -> bool:
        if not self.in_table_scope(("tr",)):
            self.wrong("end-tag")
            return False
        self.clear_to(("tr",))
        self.pop()
        self.mode = "in_table_body"
        return True

    def start_in_row(self, name, attrs) -> None:
        if name in _CELLS:
            self.clear_to(("tr",))
            self.insert(name, attrs)
            self.mode = "in_cell"
            self.formatting.append(None)
        elif name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr"):
            if self._end_row():
                self.start_in_table_body(name, attrs)
        else:
            self.start_in_table(name, attrs)

    def end_in_row(self, name) -> None:
        if name == "tr":
            self._end_row()
        elif name == "table":
            if self._end_row():
                self.end_in_table_body(name)
        elif name in _BODIES:
            if not self.in_table_scope((name,)):
                self.wrong("end-tag")
            elif self._end_row():
                self.end_in_table_body(name)
        elif name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            self.wrong("end-tag")
        else:
            self.end_in_table(name)

    def text_in_cell(self, s: str) -> None:
        self.text_in_body(s)

    def _close_cell(self) -> None:
        self.implied()
        if not self.is_html(self.current, _CELLS):
            self.wrong("end-tag")
        self.pop_until(_CELLS)
        self.clear_formatting()
        self.mode = "in_row"

    def start_in_cell(self, name, attrs) -> None:
        if name in _TABLE_PARTS:
            if not self.in_table_scope(_CELLS):
                self.wrong("start-tag")
                return
            self._close_cell()
            self.start_in_row(name, attrs)
        else:
            self.start_in_body(name, attrs)

    def end_in_cell(self, name) -> None:
        if name in _CELLS:
            if not self.in_table_scope((name,)):
                self.wrong("end-tag")
                return
            self.implied()
            if not self.is_html(self.current, (name,)):
                self.wrong("end-tag")
            self.pop_until((name,))
            self.clear_formatting()
            self.mode = "in_row"
        elif name in ("body", "caption", "col", "colgroup", "html"):
            self.wrong("end-tag")
        elif name in ("table", "tbody", "tfoot", "thead", "tr"):
            if not self.in_table_scope((name,)):
                self.wrong("end-tag")
                return
            self._close_cell()
            self.end_in_row(name)
        else:
            self.end_in_body(name)

    # -- templates -----------------------------------------------------------------------------------------------------

    def text_in_template(self, s: str) -> None:
        self.text_in_body(s)

    def start_in_template(self, name, attrs) -> None:
        if name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
            self.start_in_head(name, attrs)
            return
        mode = {"caption": "in_table", "colgroup": "in_table", "tbody": "in_table", "tfoot": "in_table", "thead": "in_table", "col": "in_column_group", "tr": "in_table_body", "td": "in_row", "th": "in_row"}.get(name, "in_body")
        self.template_modes[-1] = self.mode = mode
        self.start_tag(name, attrs, False)

    def end_in_template(self, name) -> None:
        if name == "template":
            self.end_template()
        else:
            self.wrong("end-tag")

    def eof_in_template(self) -> None:
        if not self.on_stack("template"):
            self._stop()
            return
        self.wrong("eof")
        self.pop_until(("template",))
        self.clear_formatting()
        self.template_modes.pop()
        self.reset_mode()
        self.eof()

    # -- after the body, framesets ---------------------------------------------------------------------------------------

    def text_after_body(self, s: str) -> None:
        space, s = self._split(s)
        if space:
            self.text_in_body(space)
        if s:
            self.wrong("character")
            self.mode = "in_body"
            self.text(s)

    def start_after_body(self, name, attrs) -> None:
        if name == "html":
            self.start_in_body(name, attrs)
        else:
            self.wrong("start-tag")
            self.mode = "in_body"
            self.start_in_body(name, attrs)

    def end_after_body(self, name) -> None:
        if name == "html":
            if self.context is not None:
                self.wrong("end-tag")
            else:
                self.mode = "after_after_body"
        else:
            self.wrong("end-tag")
            self.mode = "in_body"
            self.end_in_body(name)

    def eof_after_body(self) -> None:
        self._stop()

    def _frameset_text(self, s: str) -> None:
        kept = "".join(c for c in s if c in SPACE)
        if len(kept) < len(s):
            self.wrong("character")
        self.insert_text(kept)

    text_in_frameset = text_after_frameset = _frameset_text

    def start_in_frameset(self, name, attrs) -> None:
        if name == "html":
            self.start_in_body(name, attrs)
        elif name == "frameset":
            self.insert(name, attrs)
        elif name == "frame":
            self.insert(name, attrs)
            self.pop()
            self.void_ok = True
        elif name == "noframes":
            self.start_in_head(name, attrs)
        else:
            self.wrong("start-tag")

    def end_in_frameset(self, name) -> None:
        if name == "frameset" and len(self.stack) > 1:
            self.pop()
            if self.context is None and not self.is_html(self.current, ("frameset",)):
                self.mode = "after_frameset"
        else:
            self.wrong("end-tag")

    def eof_in_frameset(self) -> None:
        if len(self.stack) > 1:
            self.wrong("eof")
        self._stop()

    def start_after_frameset(self, name, attrs) -> None:
        if name == "html":
            self.start_in_body(name, attrs)
        elif name == "noframes":
            self.start_in_head(name, attrs)
        else:
            self.wrong("start-tag")

    def end_after_frameset(self, name) -> None:
        if name == "html":
            self.mode = "after_after_frameset"
        else:
            self.wrong("end-tag")

    def eof_after_frameset(self) -> None:
        self._stop()

    def text_after_after_body(self, s: str) -> None:
        self.text_after_body(s)

    def start_after_after_body(self, name, attrs) -> None:
        self.start_after_body(name, attrs)

    def end_after_after_body(self, name) -> None:
        self.wrong("end-tag")
        self.mode = "in_body"
        self.end_in_body(name)

    eof_after_after_body = eof_after_after_frameset = eof_after_body

    def text_after_after_frameset(self, s: str) -> None:
        kept = "".join(c for c in s if c in SPACE)
        if len(kept) < len(s):
            self.wrong("character")
        if kept:
            self.text_in_body(kept)

    def start_after_after_frameset(self, name, attrs) -> None:
        self.start_after_frameset(name, attrs)

    def end_after_after_frameset(self, name) -> None:
        self.wrong("end-tag")

    def reset_mode(self) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            n, last = self.stack[i], i == 0
            if last and self.context is not None:
                n = self.context
            if n.ns == HTML:
                name = n.name
                if name in _CELLS and not last:
                    self.mode = "in_cell"
                elif name == "tr":
                    self.mode = "in_row"
                elif name in _BODIES:
                    self.mode = "in_table_body"
                elif name in ("caption", "table", "body", "frameset"):
                    self.mode = "in_" + name
                elif name == "colgroup":
                    self.mode = "in_column_group"
                elif name == "template":
                    self.mode = self.template_modes[-1]
                elif name == "head" and not last:
                    self.mode = "in_head"
                elif name == "html":
                    self.mode = "before_head" if self.head is None else "after_head"
                else:
                    if last:
                        self.mode = "in_body"
                        return
                    continue
                return
            if last:
                self.mode = "in_body"


_BODY = {n: Builder.b_head for n in _set("base basefont bgsound link meta noframes script style template title")}
_BODY |= dict.fromkeys(BLOCKS, Builder.b_block) | dict.fromkeys(HEADINGS, Builder.b_heading) | dict.fromkeys(("pre", "listing"), Builder.b_pre)
_BODY |= dict.fromkeys(FORMATTING, Builder.b_format) | dict.fromkeys(("li", "dd", "dt"), Builder.b_item)
_BODY |= dict.fromkeys(("applet", "marquee", "object"), Builder.b_marked) | dict.fromkeys(("area", "br", "embed", "img", "keygen", "wbr"), Builder.b_void)
_BODY |= dict.fromkeys(("param", "source", "track"), Builder.b_param) | dict.fromkeys(("rb", "rtc", "rp", "rt"), Builder.b_ruby)
_BODY |= dict.fromkeys((*_TABLE_PARTS, "frame", "head"), Builder.b_ignored)
_BODY |= {
    "html": Builder.b_html, "body": Builder.b_body, "frameset": Builder.b_frameset, "form": Builder.b_form, "plaintext": Builder.b_plaintext, "button": Builder.b_button, "a": Builder.b_a, "nobr": Builder.b_nobr, "table": Builder.b_table,
    "input": Builder.b_input, "hr": Builder.b_hr, "image": Builder.b_image, "textarea": Builder.b_textarea, "xmp": Builder.b_xmp, "iframe": Builder.b_iframe, "noembed": Builder.b_noembed, "select": Builder.b_select, "option": Builder.b_option,
    "optgroup": Builder.b_optgroup, "math": Builder.b_foreign, "svg": Builder.b_foreign,
}


def parse_tree(text: str, limits: Limits | None = None, context: tuple[str, str] | None = None, comments: bool = True) -> Builder:
    """The builder after a parse of `text`; its `doc` is the tree, and for a fragment the children of `doc`'s only child."""
    b = Builder(preprocess(text), limits, context, comments)
    b.parse()
    return b
