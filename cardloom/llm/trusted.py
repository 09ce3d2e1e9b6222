"""Trusted residue records, composed from public grammars; the README says what of the tables was known when they were written.

Status texts come from the registry of HTTP reason phrases, script notices and refusals from small grammars in four
languages, placeholders from the syntaxes of public template languages, filler from a Latin text of 45 BC that printers use.
"""

from __future__ import annotations

from http import HTTPStatus
from itertools import product

# Names that templates commonly fill in.
_NAMES = ["name", "author", "date", "url", "user.email", "summary", "content", "firstName", "page_title", "description"]
# Forms of unfilled placeholders in public template languages; N stands for the name.
_SYNTAXES = ["{{N}}", "{{ N }}", "{{{N}}}", "{N}", "${N}", "#{N}", "[[N]]", "%(N)s", "@@N@@", "__N__", "<%= N %>", "{% include N %}", "{% if N %}"]
# editors' notes in brackets; N stands for what is to be filled in, whatever it is.
_NOTES = ["[insert N]", "[your N]", "[add N]", "[enter N]", "[N here]", "[N TBD]", "[N TBA]", "[N to come]", "[to be added]", "<insert N>", "<your N>", "<enter N>", "<add N>", "<N here>"]

# Script notices per language as lists of alternatives to be read in sequence.
_SCRIPTS = [
    (["Please enable", "Please turn on", "Please activate", "You must enable", "Allow", "Switch on"], ["JavaScript", "scripts", "scripting"], ["in your browser.", "and reload.", "to continue.", "to use this site.", "to read this page.", "in your browser settings."]),
    (["This site", "This page", "This application", "The viewer", "Our website"], ["requires", "needs", "depends on", "will not work without"], ["JavaScript.", "scripts.", "a browser with scripts.", "JavaScript to be turned on."]),
    (["JavaScript", "Scripting", "Script support"], ["is disabled", "is turned off", "appears to be blocked", "is not available", "is not supported"], ["in your browser.", "by this client.", "on your device.", "by your settings."]),
    (["Nothing can be displayed", "Content is not available", "Comments are not shown", "The page cannot load", "Loading..."], ["without JavaScript.", "because scripts are blocked.", "unless scripting is allowed."]),
    (["Bitte aktivieren Sie", "Bitte erlauben Sie", "Schalten Sie"], ["JavaScript", "Skripte"], ["in Ihrem Browser.", "und laden Sie die Seite neu.", "um fortzufahren."]),
    (["Diese Seite", "Diese Anwendung", "Der Inhalt"], ["benötigt", "erfordert", "funktioniert nicht ohne", "braucht"], ["JavaScript.", "Skripte.", "einen Browser mit Skripten."]),
    (["Veuillez activer", "Merci d'activer", "Autorisez"], ["JavaScript", "les scripts"], ["dans votre navigateur.", "pour continuer.", "puis rechargez la page."]),
    (["Ce site", "Cette application", "Le contenu"], ["nécessite", "requiert", "ne fonctionne pas sans"], ["JavaScript.", "les scripts.", "un navigateur avec scripts."]),
    (["Por favor, active", "Habilite", "Permita"], ["JavaScript", "los scripts"], ["en su navegador.", "para continuar.", "y recargue la página."]),
    (["Este sitio", "Esta aplicación", "El contenido"], ["necesita", "requiere", "no funciona sin"], ["JavaScript.", "scripts.", "un navegador con scripts."]),
]
# Refusals and failures as lists of alternatives to be read in sequence.
_FAILURES = [
    (["The page", "The address", "The link", "The URL", "The file", "The document", "The article"], ["you requested", "you are looking for", "you followed", "you entered"], ["could not be found.", "does not exist.", "no longer exists.", "was removed.", "has been moved.", "is broken.", "is not available."]),
    (["Oops!", "Sorry,", "Whoops!", "Uh-oh!"], ["that page is missing.", "this link has died.", "something went wrong.", "an error occurred.", "we cannot find that page.", "the page failed to load."]),
    (["The server", "The service", "This website", "The gateway", "The proxy"], ["is temporarily unavailable.", "is down for maintenance.", "is overloaded.", "did not respond.", "returned an error.", "took too long to respond.", "is not reachable.", "could not complete your request."]),
    (["Access", "Your access", "Your request", "Your IP address", "Your network"], ["is denied.", "has been blocked.", "was blocked by a firewall.", "was refused.", "is not allowed.", "has been limited."]),
    (["You do not have permission", "You are not authorized", "You are not allowed"], ["to access this page.", "to open this resource.", "to see this."]),
    (["Too many requests.", "Rate limit exceeded.", "Quota exceeded.", "Unusual traffic detected."], ["Please wait.", "Try again later.", "Slow down and retry.", "Try again in a few minutes."]),
    (["Please verify", "Confirm", "Prove"], ["that you are not a robot.", "you are a human.", "you are human by completing the captcha."]),
    (["Checking", "We are checking", "Verifying"], ["your browser.", "if the site connection is secure.", "your connection before access.", "your browser, please wait a few seconds."]),
    (["Connection", "The connection", "The request"], ["timed out.", "was reset.", "refused.", "failed.", "closed unexpectedly."]),
    (["Certificate", "The security certificate"], ["is invalid.", "has expired.", "is not trusted."]),
    (["Session", "Your session", "Your login"], ["expired.", "has timed out.", "has ended, please sign in again."]),
    (["Please"], ["try again later.", "reload the page.", "refresh your browser.", "contact the administrator.", "contact support.", "return to the homepage.", "come back later.", "log in again."]),
    (["The article", "The content", "This video", "The feed", "The search"], ["could not be loaded.", "failed to load.", "returned no results.", "is empty.", "sent no data."]),
    (["Error code", "Reference", "Incident", "Request ID", "Ray ID", "Ticket", "Code"], ["0a1b2c3d"]),
    (["Die Seite", "Die Adresse", "Das Dokument"], ["wurde nicht gefunden.", "existiert nicht.", "ist nicht verfügbar.", "konnte nicht geladen werden."]),
    (["Der Server", "Der Dienst"], ["ist nicht erreichbar.", "ist vorübergehend nicht verfügbar.", "wird gewartet.", "antwortet nicht."]),
    (["Zugriff verweigert.", "Kein Zugriff.", "Zu viele Anfragen.", "Fehler", "Ein Fehler ist aufgetreten.", "Interner Serverfehler"], ["Vorgang 0a1b2c3d", "Bitte versuchen Sie es später erneut.", "Code 500"]),
    (["La page", "L'adresse", "Le document"], ["est introuvable.", "n'existe pas.", "n'existe plus.", "n'est pas disponible.", "n'a pas pu être chargée."]),
    (["Le serveur", "Le service"], ["est indisponible.", "est momentanément inaccessible.", "est en maintenance.", "ne répond pas."]),
    (["Accès refusé.", "Accès interdit.", "Trop de requêtes.", "Erreur", "Une erreur est survenue.", "Erreur interne"], ["Référence 0a1b2c3d", "Veuillez réessayer plus tard.", "Code 500"]),
    (["La página", "La dirección", "El documento"], ["no se encontró.", "no existe.", "ya no existe.", "no está disponible.", "no se pudo cargar."]),
    (["El servidor", "El servicio"], ["no está disponible.", "está en mantenimiento.", "no responde."]),
    (["Acceso denegado.", "Acceso prohibido.", "Demasiadas solicitudes.", "Error", "Se ha producido un error.", "Error interno"], ["Referencia 0a1b2c3d", "Vuelva a intentarlo más tarde.", "Código 500"]),
]
# Filler of layouts and forms, and words that programs print in place of a value.
_FILLER = [
    "placeholder", "placeholder text", "sample text", "dummy text", "dummy content", "filler text", "example text", "Replace this text.", "Edit this text.", "This is a sample paragraph.", "Text goes here", "Content goes here", "Add your text", "Write something here", "Type here",
    "Title goes here", "Heading Subheading Body", "Description to follow", "Summary coming", "Coming soon", "To be announced", "To be written", "To be determined", "TODO", "TODO: add text", "TBA", "TBD", "FIXME", "N/A", "test", "test test", "testing testing one two", "foo bar baz", "asdf", "asdf asdf asdf", "qwerty qwerty", "xxx xxx xxx", "blah blah blah", "abc abc abc",
    "Blindtext", "Platzhalter", "Beispieltext", "Hier steht Text", "Text folgt", "Texte ici", "Texte à venir", "Exemple de texte", "Texto aquí", "Texto de ejemplo", "Próximamente", "Bientôt disponible",
]
# What programs print in place of a value, pieces of programs, and messages of interpreters and databases.
_PROGRAM = [
    "null", "null null", "undefined", "undefined undefined", "None", "None None None", "NaN", "NaN NaN", "NaN%", "[object Object]", "[object HTMLElement]", "Infinity", "false", "true",
    "function main() { return null; }", "function () { return true; }", "var a = b;", "let value = undefined;", "const x = document.querySelector('div');", "document.getElementById('id').innerHTML = '';", "window.onload = function() {}", "if (x === undefined) { return; }", "console.log(error);", "import os", "print(x)", "SELECT * FROM table", "<noscript>", "<script>",
    "Traceback:", "File \"main.py\", line 1, in run", "KeyError: 'key'", "ValueError: invalid value", "TypeError: Cannot read properties of undefined", "Uncaught ReferenceError: x is not defined", "Exception in thread main", "NullPointerException at line 1", "Fatal error: Uncaught Error", "Fatal error: Call to undefined function f() on line 1", "Parse error: unexpected end of file on line 1", "Warning: Undefined variable on line 1", "Stack trace: #0 main", "Segmentation fault",
    "You have an error in your SQL syntax near 'x' at line 1", "Error establishing a database connection", "Could not connect to the database (errno 1)", '{"error": "not found"}', '{"error": {"code": 1, "message": "failed"}}', '{"status": 500, "message": "timed out"}', "code: 500, message: error",
]
# What stands beside the failures of servers and browsers.
_BESIDE = ["Not secure.", "Your connection is not private.", "Go back.", "Return to homepage", "nginx", "Apache Server at Port 80", "cloudflare", "proxy/1.0", "(c) server"]
# The words of the printers' Latin filler, in alphabetical order, and the opening of the passage after it.
_LATIN = [
    "ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore duis ea eiusmod elit enim esse est et eu ex excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum lorem magna minim mollit nisi non nostrud nulla occaecat officia pariatur proident qui quis reprehenderit sed sint sit sunt tempor ullamco ut velit veniam voluptate",
    "Lorem ipsum", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.",
    "Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.",
]
#: Kinds of residue whose texts consist of words.
KINDS = ("failure", "script", "filler", "latin", "program")


def _status_records() -> list[str]:
    """Reason phrases of client and server errors, in the forms in which servers print them."""
    errors = [s for s in HTTPStatus if s.value >= 400]
    return [form for s in errors for form in (f"{s.value} {s.phrase}", s.phrase, f"HTTP Error {s.value}", f"Error {s.value}: {s.phrase}", s.description) if form]


def _spoken(grammars: list[tuple[list[str], ...]]) -> list[str]:
    return [" ".join(parts) for grammar in grammars for parts in product(*grammar)]


def trusted_records() -> dict[str, list[str]]:
    """All trusted records by kind, in a fixed order; placeholders stand with the filler."""
    marks = [form.replace("N", name) for form in _SYNTAXES for name in _NAMES]
    return {"failure": _status_records() + _spoken(_FAILURES) + _BESIDE, "script": _spoken(_SCRIPTS), "filler": _FILLER + marks + _NOTES, "latin": _LATIN, "program": _PROGRAM}
