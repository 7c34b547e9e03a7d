import random
from re import _parser

import pytest

from rankstead.llm import residue

CASES = {
    "field": ["of {{ run_id }} made", "Dear {{name}},", "a {% locus %} b", "<%= score %> of", "because ${doc.title} anchors", "was #{run_id} for", "the [[score]] at", "a @@cutoff@@ b", "interval «table_caption» from",
              "the %(n_ligands)s answer", "used %LOCUS% another", "178,423 $ALLELE$ 73", "x __reviewer__ y", "for {TABLE_CAPTION} older", "by <SCORE> only", "The [TABLE_CAPTION] at"],
    "prompt": ["TODO: fill in figure legend", "TBD – allele list goes here", "<!-- cut-off text goes here -->", "Click to edit date of run", "dates XXX reference XXX 2021", "in [INSERT PEPTIDE TABLE HERE] log", "[Name of reference]",
               "a [FIGURE LEGEND TO COME] b", "[add title before release]", "<enter reference>", "Your title goes in this box, replace it with your own words."],
    "filler": ["Lorem ipsum dolor sit amet", "Dolor velit nostrud ipsum aute aute nisi.", "Here is a dummy paragraph so that the page looks full.", "Text text text text", "Blah blah blah", "Mustertext, bitte ersetzen.", "Texto de relleno para x",
               "Texte d'exemple à remplacer", "ここにテキストを入力してください。", "Example body copy for the summary."],
    "error": ["Page nоt found.", "404 – THE RECORD YOU ASKED FOR DOES NOT EXIST", "Internal server error. Incident 4", "HTTP 503 Bad gateway", "Request timed out while waiting", "The page service is down for maintenance", "ACCESS DENIED.",
              "Your session has ended. Sign in", "Unable to load page: unexpected", "Fatal: could not connect to the x database", "undefined index 'x' in render on line 5", "Too many requests", "This record is no longer available", "Error 504: x",
              "Die Seite wurde nicht gefunden", "Le service est momentanément indisponible", "Acceso denegado. Inicie", "サーバーが混み合っています", "Erreur 504 : cette page est introuvable"],
    "scripts": ["Please turn on JavaScript to view", "You need to enable JavaScript", "check that your browser allows scripting", "Scripts are blocked – allow them", "noscript: the viewer cannot start without javascript", "This page requires scripts.",
                "Bitte aktivieren Sie JavaScript, um", "Veuillez activer JavaScript", "Active JavaScript para ver", "JavaScriptを有効にしてください"],
}
CLEAN = [None, "", "   ", "The viewer needs JavaScript, which is off on the cluster; the exported table has the same numbers.", "JavaScript braucht nur die Ansicht im Browser, nicht die Tabelle.",
         "The job timed out twice, and the server was down for maintenance on 2024-03-25, as the diary says.", "Error 0.38 was the largest we met; page 404 of the supplement lists it.", "The form once showed a bare field name in double braces",
         "A placeholder residue stands where X could not be resolved.", "We left the title to be decided and the data to be inserted into the appendix by us.", "Access to the freezer was denied to us until 2020.",
         'name = f"{allele}__{peptide}"', 'for a in $(cat p); do score --allele "${a}" --out "${OUT}/${a}.txt"; done', 'print("{:.3f}".format(score))', "Here S = {p : |p| = 9} and $\\frac{1}12\\sum_{i} x_{i}$ is", '{"k": [1, 2]}', "In the set {A, B, C} of loci",
         "A&nbsp;B &amp; <b>x</b> <TABLE>", "Filler peptides such as X keep the plate balanced.", "Dummy variables for A and B went into the regression.", "An early draft began with the usual mock Latin; it was replaced", "Of 9 peptides, 404 had no partner and 503 had more.",
         "the archive answered with a not-found page, so we", "Der Server antwortete mit einer Fehlerseite", "2019 [INFO] x", "[68] gives the counts.", "it was __from__ the same plate", "if __name__ == '__main__':", "Le serveur a rendu une page d'erreur"]


@pytest.mark.parametrize("kind", CASES)
def test_evidence(kind):
    for text in CASES[kind]:
        assert residue.evidence(text) == kind, text
        assert residue.evidence(f"The table is long.\n{text}\nThe end of it.") == kind, text


def test_clean_texts():
    for text in CLEAN:
        assert residue.evidence(text) is None, text


def test_very_long_text_is_read_to_its_end():
    assert residue.evidence("the rows of the table were read again. " * 20_000 + "Page not found.") == "error"


def test_boilerplate_is_subtracted_but_evidence_stays(spark):
    rows = [(i, f"Home | {i % 10} | Help\nbody {chr(97 + i % 26) * 9}\n" + ("Page not found." if i % 2 else "fine"), "hot") for i in range(60)] + [(100 + i, "Home | 5 | Help", f"h{i}") for i in range(5)] + [(200, None, None), (201, "", "hot")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumn("kind", residue.F.lit("clash"))
    plates = {r["host"]: r["lines"] for r in residue.boilerplate(df, "doc_id", "text", "source").collect()}
    assert plates == {"hot": ["fine", "home | 0 | help", "page not found."]}
    got = {r["doc_id"]: r["kind"] for r in residue.find_residue(df, "doc_id", "text", "source").collect()}
    assert len(got) == 67 and {i for i, k in got.items() if k} == {i for i in range(60) if i % 2}
    assert residue.find_residue(df.limit(0), "doc_id", "text", "source").count() == 0


def test_subtraction_decides_lines_of_code_and_menus(spark):
    """A line that many notes quote is boilerplate, in its host or over all; the same syntax on a line of its own is a field."""
    code = 'for a in $(cat panel.txt); do score --out "${out}/1.txt"; done'
    rows = [(i, f"body {chr(97 + i)}\n{code}", "hot") for i in range(24)] + [(100 + i, code.replace("1", "7"), f"h{i}") for i in range(6)]
    rows += [(200, 'It reads "${run_title}/x" here', "hot"), (201, f"{code}\nLorem ipsum", "hot"), (202, f"{code}\nsee <first_author>, please", "hot"), (203, "Try again later", "x"), (204, None, None)]
    rows += [(300 + i, f"Menu\nTry again later\nrow {chr(97 + i)}", "menu") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r["doc_id"]: r["kind"] for r in residue.find_residue(df, "doc_id", "text", "source").collect()}
    assert {i: k for i, k in got.items() if k} == {200: "field", 201: "filler", 202: "field"} and len(got) == len(rows)
    few = residue.find_residue(df.filter("doc_id IN (1, 2, 203)"), "doc_id", "text", "source").collect()
    assert {r["doc_id"]: r["kind"] for r in few} == {1: "field", 2: "field", 203: "error"}


def test_boilerplate_never_hides_the_rest(spark):
    rows = [(i, "Menu 1\nLorem ipsum" if i == 5 else " MENU 2 ", "h") for i in range(30)]
    got = residue.find_residue(spark.createDataFrame(rows, "doc_id int, text string, source string"), "doc_id", "text", "source").collect()
    assert {r["doc_id"] for r in got if r["kind"] == "filler"} == {5} and sum(r["kind"] is not None for r in got) == 1
    assert sorted(r["line"] for r in residue.boilerplate_lines(spark.createDataFrame(rows, "doc_id int, text string, source string"), "text", "source").collect()) == ["menu 0"]


@pytest.mark.parametrize("line", ["Error 503: x", "404 Not Found", "403 Forbidden", "HTTP 502 again", "{TABLE_CAPTION}", "[RUN_DATE]", "<SCORE>"])
def test_recurrent_evidence_is_judged_on_the_raw_line(spark, line):
    df = spark.createDataFrame([(i, f"Home | {i} | Help\nbody {i}\n{line}", "hot") for i in range(60)] + [(100 + i, f"Home | {i} | Help\nbody", "hot") for i in range(20)], "doc_id int, text string, source string")
    got = {r["doc_id"]: r["kind"] for r in residue.find_residue(df, "doc_id", "text", "source").collect()}
    assert {i for i, k in got.items() if k} == set(range(60))


def test_evidence_of_several_lines_is_judged_on_the_residual_text(spark):
    """A block of lines that many notes quote is subtracted, though the whole text would match; alone it is a field."""
    block = "{{\n  panel row\n}}"
    rows = [(i, f"body {chr(97 + i)}\n{block}\nend", "hot") for i in range(20)] + [(100 + i, f"x{chr(97 + i)}\n{block}", f"h{i}") for i in range(3)]
    rows += [(200, "one\n{{\n  run title\n}}", "hot"), (201, f"{block}\nPage not found.", "hot"), (202, f"{block}\nsee <first_author>, please", "h9"), (203, "TODO:\nadd the legend", "h8")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r["doc_id"]: r["kind"] for r in residue.find_residue(df, "doc_id", "text", "source").collect()}
    assert len(got) == len(rows) and {i: k for i, k in got.items() if k} == {201: "error", 202: "field", 203: "prompt"}
    alone = residue.find_residue(df.filter("doc_id IN (1, 2, 200)"), "doc_id", "text", "source").collect()
    assert {r["kind"] for r in alone} == {"field"} and len(alone) == 3


def wording(parsed, rnd):
    """Some text that a parsed pattern may match, all its alternatives being equally likely."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            kind, value = rnd.choice([("LITERAL", ord(x)) for x in " k"] if str(arg[0][0]) == "NEGATE" else arg)
            out += chr(value if str(kind) == "LITERAL" else rnd.randint(*value)) if str(kind) != "CATEGORY" else {"CATEGORY_WORD": "k", "CATEGORY_DIGIT": "5", "CATEGORY_SPACE": " "}[str(value)]
        elif op == "NOT_LITERAL":
            out += rnd.choice(" k")
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = arg
            out += "".join(wording(inner, rnd) for _ in range(rnd.randint(least, min(int(most), least + 3))))
        elif op == "BRANCH":
            out += wording(rnd.choice(arg[1]), rnd)
        elif op == "SUBPATTERN":
            out += wording(arg[-1], rnd)
        else:
            assert op in ("AT", "ASSERT", "ASSERT_NOT"), op
    return out


@pytest.mark.parametrize("k", range(len(residue.EVIDENCE)))
def test_triggers_are_no_narrower_than_their_pattern(k):
    _, triggers, pattern = residue.EVIDENCE[k]
    rnd, n = random.Random(k), 0
    for _ in range(600):
        text = wording(_parser.parse(pattern.pattern), rnd)
        if pattern.search(residue.fold(text)):
            n += 1
            assert any(t in residue.fold(text) for t in triggers), (text, triggers)
            assert residue.evidence(text), text
    assert n >= 20


@pytest.mark.parametrize(
    "kind, text",
    [("error", f"The page you {x} {y}.") for x in ("asked for", "requested", "are looking for") for y in ("does not exist", "could not be found", "was not found", "cannot be found", "is not available")]
    + [("error", f"It may have {x} or {y}") for x in ("moved", "been moved", "been removed") for y in ("withdrawn", "deleted", "renamed")]
    + [("error", x) for x in ("HTTP/1.1 401 Unauthorized", "HTTP/2 429", "HTTP 502", "HTTP error 500", "Your session ended.", "Your session timed out.", "Your session has expired.", "Your session has timed out.")]
    + [("scripts", x) for x in ("JavaScript must be enabled to view this page", "Scripts need to be turned on", "スクリプトを有効にしてください", "スクリプトが無効になっています", "JavaScriptがオフになっています")],
)
def test_wordings_that_triggers_missed(kind, text):
    assert residue.evidence(text) == kind


# Wordings of well-known servers, browsers and site builders, written down without looking at the test tables.
USUAL = [
    "The requested URL was not found on this server.", "500 Internal Server Error nginx", "502 Bad Gateway", "503 Service Temporarily Unavailable", "This site can’t be reached",
    "Forbidden: You don't have permission to access this resource.", "Sorry, the page you were looking for doesn't exist.", "Error establishing a database connection", "Server Error in '/' Application.",
    "Warning: mysql_connect(): Access denied for user", "Fatal error: Uncaught Exception in /var/www/html/index.php on line 12", "The connection has timed out", "This content is no longer available",
    "Application error: a client-side exception has occurred", "The server encountered an internal error and was unable to complete your request", "Whoops, looks like something went wrong.",
    "Sorry for the inconvenience, we're performing some maintenance at the moment", "Your text here", "This is placeholder text", "Hier könnte Ihr Text stehen", "Insert your content here",
    "[Your Company Name]", "Welcome {{ user.first_name }}", "Hello %FIRSTNAME%", "Dear [First Name]", "<INSERT TITLE>", "TODO: write this section", "Please enable JavaScript to continue using this application.",
    "You need to enable JavaScript to run this app.", "JavaScript is required to use this site", "Your browser does not support JavaScript", "This site requires JavaScript to be enabled",
    "Enable JavaScript and cookies to continue", "JavaScript is disabled in your browser",
]
# The same, kept apart: no pattern was written for these.
HELD_OUT = [
    "404 Error: The resource you requested cannot be located.", "Unfortunately this page has been removed.", "HTTP Error 404.0 - Not Found", "Service Unavailable - Zero size object", "Gateway Timeout",
    "Error 1020 Access denied", "Sorry, you have been blocked", "Your session has timed out, please log in again.", "An error occurred while processing your request.", "This page isn't working", "ERR_CONNECTION_REFUSED",
    "The service is unavailable.", "Parse error: syntax error, unexpected end of file in /srv/a.php on line 3", "Uncaught TypeError: Cannot read properties of undefined", "JavaScript must be enabled in order to use this website",
    "Please turn JavaScript on and reload the page", "We're sorry but this app doesn't work properly without JavaScript enabled.", "Este sitio requiere JavaScript", "Diese Seite benötigt JavaScript",
    "Ce site nécessite JavaScript", "Hello {{first_name}}, welcome", "Dear {FIRST_NAME}", "Dear [Your Name]", "Lorem ipsum dolor", "Your content goes here", "Add your text here", "Placeholder text for the summary",
    "Title goes here", "TODO: add description", "Este contenido ya no está disponible",
]


def test_recall_on_usual_wordings():
    missed = [x for x in USUAL if not residue.evidence(x)]
    assert not missed, missed
    assert sum(residue.evidence(x) is not None for x in HELD_OUT) >= 18 # of 30; 15 before the patterns were widened for USUAL
