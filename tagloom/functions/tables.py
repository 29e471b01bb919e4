"""Fixed values of the HTML language that results depend on.

Everything here is a stated value (word lists, names, patterns), none is logic.
"""

from __future__ import annotations

from html.entities import html5 as ENTITIES  # noqa: F401  the 2231 named references, with and without ";"

HTML = "http://www.w3.org/1999/xhtml"
MATHML = "http://www.w3.org/1998/Math/MathML"
SVG = "http://www.w3.org/2000/svg"
XLINK = "http://www.w3.org/1999/xlink"
XML = "http://www.w3.org/XML/1998/namespace"
XMLNS = "http://www.w3.org/2000/xmlns/"

PREFIXES = {HTML: "html", MATHML: "math", SVG: "svg", XLINK: "xlink", XML: "xml", XMLNS: "xmlns"}
SPACES = "\t\n\x0c \r"

# Element categories.
SCOPING = {(HTML, n) for n in "applet caption html marquee object table td th".split()} | {(MATHML, n) for n in "mi mo mn ms mtext annotation-xml".split()} | {(SVG, n) for n in "foreignObject desc title".split()}
SPECIAL = {
    (HTML, n)
    for n in (
        "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup command dd details dir div dl dt embed "
        "fieldset figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe image img input isindex li link listing marquee menu meta nav "
        "noembed noframes noscript object ol p param plaintext pre script section select style table tbody td textarea tfoot th thead title tr ul wbr xmp"
    ).split()
} | {(SVG, "foreignObject")}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
MATHML_TEXT_POINTS = {(MATHML, n) for n in "mi mo mn ms mtext".split()}
SVG_HTML_POINTS = {(SVG, n) for n in "foreignObject desc title".split()}
VOID = frozenset("area base br col command embed event-source hr img input link meta param source track wbr".split())
#: Content kept raw by the serializer, and content with references, under the names used here.
RAW_TEXT = frozenset("style script xmp iframe noembed noframes noscript".split())
ESCAPABLE_TEXT = frozenset(("title", "textarea"))
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p section summary ul".split())
BLOCK_ENDS = frozenset("address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol pre section summary ul".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
BOOLEAN_ATTRIBUTES = {
    "": "irrelevant itemscope", "style": "scoped", "img": "ismap", "audio": "autoplay controls", "video": "autoplay controls", "script": "defer async", "details": "open",
    "datagrid": "multiple disabled", "command": "hidden disabled checked default", "hr": "noshade", "menu": "autosubmit", "fieldset": "disabled readonly",
    "option": "disabled readonly selected", "optgroup": "disabled readonly", "button": "disabled autofocus", "input": "disabled readonly required autofocus checked ismap",
    "select": "disabled readonly autofocus multiple", "ol": "reversed", "output": "disabled readonly", "iframe": "seamless",
}

# Camel-case names of SVG elements and attributes; the parser sees them in lower case.
SVG_TAGS = {
    n.lower(): n
    for n in (
        "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix "
        "feDiffuseLighting feDisplacementMap feDistantLight feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset "
        "fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath"
    ).split()
}
SVG_ATTRIBUTES = {
    n.lower(): n
    for n in (
        "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits contentScriptType contentStyleType diffuseConstant edgeMode externalResourcesRequired "
        "filterRes filterUnits glyphRef gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight "
        "markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha "
        "preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset "
        "stdDeviation stitchTiles surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan"
    ).split()
}
MATHML_ATTRIBUTES = {"definitionurl": "definitionURL"}
FOREIGN_ATTRIBUTES = {f"xlink:{n}": (XLINK, "xlink", n) for n in "actuate arcrole href role show title type".split()} | {f"xml:{n}": (XML, "xml", n) for n in "base lang space".split()} | {"xmlns": (XMLNS, None, "xmlns"), "xmlns:xlink": (XMLNS, "xmlns", "xlink")}

# Public identifiers of quirks mode, in lower case.
QUIRKS_PREFIXES = (
    "+//silmaril//dtd html pro v0r11 19970101//", "-//advasoft ltd//dtd html 3.0 aswedit + extensions//", "-//as//dtd html 3.0 aswedit + extensions//",
    "-//ietf//dtd html 2.0 level 1//", "-//ietf//dtd html 2.0 level 2//", "-//ietf//dtd html 2.0 strict level 1//", "-//ietf//dtd html 2.0 strict level 2//",
    "-//ietf//dtd html 2.0 strict//", "-//ietf//dtd html 2.0//", "-//ietf//dtd html 2.1e//", "-//ietf//dtd html 3.0//", "-//ietf//dtd html 3.2 final//",
    "-//ietf//dtd html 3.2//", "-//ietf//dtd html 3//", "-//ietf//dtd html level 0//", "-//ietf//dtd html level 1//", "-//ietf//dtd html level 2//",
    "-//ietf//dtd html level 3//", "-//ietf//dtd html strict level 0//", "-//ietf//dtd html strict level 1//", "-//ietf//dtd html strict level 2//",
    "-//ietf//dtd html strict level 3//", "-//ietf//dtd html strict//", "-//ietf//dtd html//", "-//metrius//dtd metrius presentational//",
    "-//microsoft//dtd internet explorer 2.0 html strict//", "-//microsoft//dtd internet explorer 2.0 html//", "-//microsoft//dtd internet explorer 2.0 tables//",
    "-//microsoft//dtd internet explorer 3.0 html strict//", "-//microsoft//dtd internet explorer 3.0 html//", "-//microsoft//dtd internet explorer 3.0 tables//",
    "-//netscape comm. corp.//dtd html//", "-//netscape comm. corp.//dtd strict html//", "-//o'reilly and associates//dtd html 2.0//",
    "-//o'reilly and associates//dtd html extended 1.0//", "-//o'reilly and associates//dtd html extended relaxed 1.0//",
    "-//softquad software//dtd hotmetal pro 6.0::19990601::extensions to html 4.0//", "-//softquad//dtd hotmetal pro 4.0::19971010::extensions to html 4.0//",
    "-//spyglass//dtd html 2.0 extended//", "-//sq//dtd html 2.0 hotmetal + extensions//", "-//sun microsystems corp.//dtd hotjava html//",
    "-//sun microsystems corp.//dtd hotjava strict html//", "-//w3c//dtd html 3 1995-03-24//", "-//w3c//dtd html 3.2 draft//", "-//w3c//dtd html 3.2 final//",
    "-//w3c//dtd html 3.2//", "-//w3c//dtd html 3.2s draft//", "-//w3c//dtd html 4.0 frameset//", "-//w3c//dtd html 4.0 transitional//",
    "-//w3c//dtd html experimental 19960712//", "-//w3c//dtd html experimental 970421//", "-//w3c//dtd w3 html//", "-//w3o//dtd w3 html 3.0//",
    "-//webtechs//dtd mozilla html 2.0//", "-//webtechs//dtd mozilla html//",
)
QUIRKS_IDS = ("-//w3o//dtd w3 html strict 3.0//en//", "-/w3c/dtd html 4.0 transitional/en", "html")
QUIRKS_SYSTEM = "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd"
HTML401_PREFIXES = ("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//")
LIMITED_PREFIXES = ("-//w3c//dtd xhtml 1.0 frameset//", "-//w3c//dtd xhtml 1.0 transitional//")

#: Numeric references 0x80-0x9F mean windows-1252; where that has no character they stay.
NUMERIC = {0: "�", 13: "\r"} | {i: bytes([i]).decode("cp1252") if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(i) for i in range(0x80, 0xA0)}

# What the sanitizer lets through.
SAFE_HTML = frozenset(
    (
        "a abbr acronym address area article aside audio b big blockquote br button canvas caption center cite code col colgroup command datagrid datalist dd del details dfn dialog dir "
        "div dl dt em event-source fieldset figcaption figure footer font form header h1 h2 h3 h4 h5 h6 hr i img input ins keygen kbd label legend li m map menu meter multicol nav nextid "
        "ol output optgroup option p pre progress q s samp section select small sound source spacer span strike strong sub summary sup table tbody td textarea time tfoot th thead tr tt u "
        "ul var video wbr"
    ).split()
)
SAFE_MATHML = frozenset(
    "maction math merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none".split()
)
SAFE_SVG = frozenset(
    (
        "a animate animateColor animateMotion animateTransform clipPath circle defs desc ellipse font-face font-face-name font-face-src g glyph hkern linearGradient line marker metadata "
        "missing-glyph mpath path polygon polyline radialGradient rect set stop svg switch text title tspan use"
    ).split()
)
SAFE_HTML_ATTRIBUTES = (
    "abbr accept accept-charset accesskey action align alt autocomplete autofocus axis background balance bgcolor bgproperties border bordercolor bordercolordark bordercolorlight "
    "bottompadding cellpadding cellspacing ch challenge char charoff choff charset checked cite class clear color cols colspan compact contenteditable controls coords data datafld "
    "datapagesize datasrc datetime default delay dir disabled draggable dynsrc enctype end face for form frame galleryimg gutter headers height hidefocus hidden high href hreflang hspace "
    "icon id inputmode ismap keytype label leftspacing lang list longdesc loop loopcount loopend loopstart low lowsrc max maxlength media method min multiple name nohref noshade nowrap "
    "open optimum pattern ping point-size poster pqg preload prompt radiogroup readonly rel repeat-max repeat-min replace required rev rightspacing rows rowspan rules scope selected "
    "shape size span src start step style summary suppress tabindex target template title toppadding type unselectable usemap urn valign value variable volume vspace vrml width wrap"
).split()
SAFE_MATHML_ATTRIBUTES = (
    "actiontype align columnalign columnlines columnspacing columnspan depth display displaystyle equalcolumns equalrows fence fontstyle fontweight frame height linethickness lspace "
    "mathbackground mathcolor mathvariant maxsize minsize other reversed rowalign rowlines rowspacing rowspan rspace scriptlevel selection separator start stretchy width"
).split()
SAFE_SVG_ATTRIBUTES = (
    "accent-height accumulate additive alphabetic arabic-form ascent attributeName attributeType baseProfile bbox begin by calcMode cap-height class clip-path color color-rendering "
    "content cx cy d dx dy descent display dur end fill fill-opacity fill-rule font-family font-size font-stretch font-style font-variant font-weight from fx fy g1 g2 glyph-name "
    "gradientUnits hanging height horiz-adv-x horiz-origin-x id ideographic k keyPoints keySplines keyTimes lang marker-end marker-mid marker-start markerHeight markerUnits markerWidth "
    "mathematical max min name offset opacity orient origin overline-position overline-thickness panose-1 path pathLength points preserveAspectRatio r refX refY repeatCount repeatDur "
    "requiredExtensions requiredFeatures restart rotate rx ry slope stemh stemv stop-color stop-opacity strikethrough-position strikethrough-thickness stroke stroke-dasharray "
    "stroke-dashoffset stroke-linecap stroke-linejoin stroke-miterlimit stroke-opacity stroke-width systemLanguage target text-anchor to transform type u1 u2 underline-position "
    "underline-thickness unicode unicode-range units-per-em values version viewBox visibility width widths x x-height x1 x2 y y1 y2 zoomAndPan"
).split()
SAFE_XLINK_ATTRIBUTES = "actuate arcrole href role show title type".split()
SAFE_XML_ATTRIBUTES = "base lang space".split()
URI_ATTRIBUTES = "href src cite action longdesc poster background datasrc dynsrc lowsrc ping".split()
SVG_REF_ATTRIBUTES = "clip-path color-profile cursor fill filter marker marker-start marker-mid marker-end mask stroke".split()
SVG_LOCAL_HREF = "altGlyph animate animateColor animateMotion animateTransform cursor feImage filter linearGradient pattern radialGradient textpath tref set use".split()
SAFE_CSS = frozenset(
    (
        "azimuth background-color border-bottom-color border-collapse border-color border-left-color border-right-color border-top-color clear color cursor direction display elevation float "
        "font font-family font-size font-style font-variant font-weight height letter-spacing line-height max-height min-height max-width min-width overflow pause pause-after pause-before "
        "pitch pitch-range richness speak speak-header speak-numeral speak-punctuation speech-rate stress text-align text-decoration text-indent unicode-bidi vertical-align voice-family "
        "volume white-space width"
    ).split()
)
SAFE_CSS_KEYWORDS = frozenset(
    (
        "auto aqua black block blue bold both bottom brown center collapse dashed dotted fuchsia gray green !important italic left lime maroon medium none navy normal nowrap olive pointer "
        "purple red right solid silver teal top transparent underline white yellow"
    ).split()
)
SAFE_SVG_CSS = frozenset("fill fill-opacity fill-rule stroke stroke-width stroke-linecap stroke-linejoin stroke-opacity".split())
SAFE_SCHEMES = "ed2k ftp http https irc mailto news gopher nntp telnet webcal xmpp callto feed urn aim rsync tag ssh sftp rtsp afs data".split()
SAFE_CONTENT_TYPES = "image/png image/jpeg image/gif image/webp image/bmp text/plain".split()
