"""Labelled lines that the residue model is taught besides the sample, put together by rule from short lists."""

from __future__ import annotations

from collections.abc import Iterator
from http import HTTPStatus
from itertools import product

# Parts of notices. Reason phrases of status codes are those of the standard library.
_THINGS = {
    "en": ("The page", "This page", "The page you requested", "This site", "The website", "The server", "The service", "This content", "The document", "The requested resource", "This application", "The link"),
    "de": ("Die Seite", "Diese Seite", "Die angeforderte Seite", "Der Server", "Der Dienst", "Dieser Inhalt"),
    "fr": ("La page", "Cette page", "La page demandée", "Le serveur", "Le service", "Ce contenu"),
    "es": ("La página", "Esta página", "La página solicitada", "El servidor", "El servicio", "Este contenido"),
}
_FAILS = {
    "en": ("could not be found.", "cannot be displayed.", "can't be reached right now.", "is not available.", "is temporarily unavailable.", "is currently down for maintenance.", "does not exist.", "has expired.", "is not responding.",
           "took too long to respond.", "failed to load.", "requires JavaScript.", "needs cookies to work.", "is restricted.", "requires you to sign in.", "is under maintenance.", "returned an unexpected error."),
    "de": ("wurde nicht gefunden.", "kann nicht angezeigt werden.", "ist derzeit nicht verfügbar.", "wird gerade gewartet.", "ist nicht erreichbar.", "benötigt JavaScript.", "existiert nicht."),
    "fr": ("est introuvable.", "ne peut pas être affichée.", "n'est pas disponible pour le moment.", "est en maintenance.", "ne répond pas.", "nécessite JavaScript.", "n'existe pas."),
    "es": ("no se ha encontrado.", "no se puede mostrar.", "no está disponible en este momento.", "está en mantenimiento.", "no responde.", "requiere JavaScript.", "no existe."),
}
_ORDERS = (
    "Please enable JavaScript to continue.", "You need to enable JavaScript to run this app.", "JavaScript is disabled in your browser.", "Your browser does not support JavaScript.", "Please turn on cookies and reload the page.",
    "Enable cookies and try again.", "Please sign in to continue.", "You must be logged in to view this content.", "Log in to your account to see this page.", "Your session has expired, please log in again.", "You do not have permission to access this page.",
    "You are not authorized to view this page.", "Access to this resource is denied.", "Please verify that you are not a robot.", "Checking your browser before you continue.", "Complete the captcha to proceed.", "Something went wrong.",
    "An unexpected error occurred.", "An error occurred while processing your request.", "Please try again later.", "Try refreshing the page.", "We'll be back shortly.", "We are performing scheduled maintenance.", "We apologize for the inconvenience.",
    "Too many requests from your address.", "Your request has been blocked.", "Please contact the administrator.", "If the problem persists, contact support.", "We're having trouble loading this page.", "We could not connect to the server.", "You have been logged out.", "Our servers are busy at the moment.", "This item has been removed.", "The file was moved or deleted.", "Sorry, we couldn't find what you were looking for.", "Oops! That page is gone.",
    "Please wait while we check your connection.", "Redirecting, please wait.", "Loading, please wait.", "Please update your browser.", "Subscribe to continue reading.", "This browser is not supported.", "The connection has timed out.", "Bitte aktivieren Sie JavaScript.",
    "Bitte melden Sie sich an, um fortzufahren.", "Ein Fehler ist aufgetreten.", "Zugriff verweigert.", "Bitte versuchen Sie es später erneut.", "Veuillez activer JavaScript.", "Veuillez vous connecter pour continuer.", "Une erreur est survenue.",
    "Vous devez être connecté pour voir cette page.", "Leider ist ein Fehler aufgetreten.", "Lo sentimos, algo ha salido mal.", "Désolé, un problème est survenu.", "Accès refusé.", "Veuillez réessayer plus tard.", "Por favor, active JavaScript.", "Inicie sesión para continuar.", "Se ha producido un error.", "Acceso denegado.", "Inténtelo de nuevo más tarde.",
)
# Parts of templates.
_WRAPS = ("{%s}", "{{%s}}", "{{ %s }}", "{{{%s}}}", "${%s}", "#{%s}", "<%%= %s %%>", "{%% %s %%}", "[%s]", "[[%s]]", "<%s>", "<<%s>>", "%%%s%%", "%%(%s)s", "__%s__", "@@%s@@", "##%s##", "XX_%s_XX")
_NAMES = ("first name", "last name", "customer name", "name", "company", "company name", "recipient", "date", "due date", "address", "city", "email", "phone number", "amount", "total", "order number", "invoice id", "title", "project", "team", "owner", "role", "subject", "link", "count", "signature")
_AROUND = ("Dear %s,", "Hi %s, thanks for your message.", "Assigned to %s until further notice.", "Your order %s has been shipped.", "# %s", "Hallo %s, Ihre Nachricht ist da.", "Bonjour %s, merci.", "Hola %s, gracias.", "Best regards, %s", "Meeting with %s on Monday.", "%s")
_ASKED = ("[Your Name]", "[your name here]", "[insert date]", "[Insert Company Name]", "[add link]", "[enter amount]", "[Name des Kunden]", "[votre nom]", "[su nombre]", "<your name>", "<insert title here>", "(insert name here)")
# What also stands between brackets or signs.
_NO_SLOT = (
    "See [1] and [12] for the details.", "- [x] done", "- [ ] open", "[12:30] Nora joined the call.", "[Nora] I will check the roster.", "He wrote [sic] in the margin.", "The quote ends here [...].", "[see note 3]", "Write to <nora@example.com> first.", "See <https://example.com/a> for more.",
    "The set {1, 2, 3} has three members.", "Let x be in {a, b, c}.", "A list of type List<String> is returned.", "The sum was $5 of 40%.", "Prices rose 10% in May and 12% in June.", "Ask @nora about #harbour.", "Call __init__ first.", "It runs __main__ at the start.", "He was **very** clear about it.", "That is _not_ the plan.",
    "Let a[i] be the next one.", "The value of f(x) is low.", "a = b + c = d", "a | b | c", "x ^ y ^ z", "The range is [0, 1].", "if (a < b && c > d)", "Press <Ctrl> and <Enter>.", "[applause] Thank you all.", "[laughter]", "MAX_SIZE_LIMIT is set.", "He said ((twice)) that it works.", "C++ and C++ are one.", "Item #12# was sold.", "[edited]", "[2024-05-01] Shipped.", "~20 boxes ~30 lids",
)
_WORDS = ("green", "left", "again", "Oslo", "Nora", "part two", "see below", "music", "int", "Enter", "north wing", "sic", "maybe", "new", "Tuesday", "a, b", "0, 1", "x", "12", "page 3")
_IN = ("He took the [%s] door.", "We saw [%s] and left.", "[%s] Thank you.", "The word {%s} is in braces.", "Press <%s> to go on.", "It was (%s) all along.", "They went ((%s)) there.", "The *%s* one was best.", "Take the |%s| road.")
# Parts of short notes.
_NOTES = {
    "en": (("Buy", "Call", "Bring", "Book", "Fix", "Water", "Send", "Check", "Return", "Pay for", "Clean", "Ask about", "Remember"), ("the tickets", "bread and cheese", "the dentist", "the garden", "my sister", "the old bike", "two boxes of paper", "the blue folder", "the rent", "the reports"), ("", " today", " before noon", " on Friday", " again")),
    "de": (("Kaufe", "Hole", "Bringe", "Prüfe", "Denk an", "Ruf an:", "Bezahle"), ("die Blumen", "das Brot", "den Zahnarzt", "die Miete", "den blauen Ordner", "meine Schwester"), ("", " heute", " am Freitag", " vor dem Essen")),
    "fr": (("Acheter", "Appeler", "Apporter", "Réserver", "Payer", "Vérifier"), ("le pain", "les billets", "le dentiste", "le loyer", "ma sœur", "le vieux vélo"), ("", " demain", " avant midi", " vendredi")),
    "es": (("Comprar", "Llamar a", "Traer", "Reservar", "Pagar", "Revisar"), ("el pan", "las entradas", "mi hermana", "el alquiler", "la carpeta azul", "los informes"), ("", " hoy", " el lunes", " antes de comer")),
}
_PEOPLE = ("Nora", "Karl", "Ines", "Paul", "Vera", "Tom")
_SAID = ("%s prefers tea.", "%s is away until Monday.", "%s will lead the team from June.", "%s signed the contract yesterday.", "%s no longer works here.", "%s found the page she was looking for.", "The meeting with %s is on Tuesday.", "%s likes long walks.", "%s moved to Bonn in June.", "%s went home by train.", "%s has a new phone.", "%s fixed the login page.", "%s asked why the server was down last week.",
         "%s mag keinen Kaffee.", "%s kommt am Freitag.", "%s aime le thé.", "%s arrive lundi.", "%s prefiere el té.", "La reunión con %s es el martes.", "%s reported that the page could not be found.", "%s wrote down how to enable JavaScript for the demo.", "%s saw an access denied message and told the team.", "%s wants the error page to say sorry.")
_FILLERS = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.", "Ut enim ad minim veniam, quis nostrud exercitation.", "Placeholder text goes here.", "This is placeholder content.", "Insert text here.", "Your text here.", "Add your description here.",
    "Sample text for this section.", "Dummy text to fill the space.", "Content coming soon.", "Text to be added later.", "To be written.", "Replace this paragraph with your own words.", "Ut wisi enim ad minim veniam, quis nostrud exerci tation.", "Nam liber tempor cum soluta nobis eleifend option congue.", "Vel illum dolore eu feugiat nulla facilisis at vero eros.", "Example paragraph, please replace.", "Blindtext für den Abschnitt.", "Hier steht später ein Text.", "Platzhaltertext, bitte ersetzen.", "Texte de remplissage.",
    "Votre texte ici.", "Texto de relleno.", "Su texto aquí.", "blah blah blah blah blah blah", "asdf asdf asdf asdf asdf", "xxx xxx xxx xxx xxx", "test test test test test test",
)
_EMPTY = ("TBD", "TODO", "n/a", "N/A", "...", "-", "___", "???", "xxx", "none yet", "to be filled in", "to be decided")
_FIELDS = ("Owner", "Name", "Date", "Team", "Status", "Title", "Contact", "Budget")


def _named(name: str) -> Iterator[str]:
    """The ways in which templates write a field's name."""
    words = name.split()
    yield from (name.title(), "_".join(words), "_".join(words).upper(), words[0] + "".join(w.title() for w in words[1:]))


def seeds() -> list[tuple[str, str]]:
    """(line, class), a few thousand, in a fixed order."""
    out = [(f"{x} {y}", "notice") for lang in _THINGS for x, y in product(_THINGS[lang], _FAILS[lang])] + [(x, "notice") for x in _ORDERS]
    out += [(t, "notice") for s in HTTPStatus if s >= 400 for t in (f"{s.value} {s.phrase}", f"Error {s.value}: {s.phrase}", f"HTTP {s.value}", f"{s.phrase}")]
    fields = [(w % n) for k, name in enumerate(_NAMES) for i, n in enumerate(_named(name)) for j, w in enumerate(_WRAPS) if (" " not in n or w[0] in "[{<") and (i + j + k) % 2 == 0]
    out += [(_AROUND[i % len(_AROUND)] % f, "slot") for i, f in enumerate(fields)] + [(_AROUND[i % len(_AROUND)] % f, "slot") for i, f in enumerate(_ASKED * 3)]
    out += [(f"{x} {y}{z}.", "clean") for lang in _NOTES for x, y, z in product(*_NOTES[lang])] + [(t % p, "clean") for t, p in product(_SAID, _PEOPLE)] + [(t, "clean") for t in _NO_SLOT * 4] + [(t % x, "clean") for t, x in product(_IN, _WORDS)]
    out += [(t, "filler") for t in _FILLERS * 3] + [(f"{f}: {e}", "filler") for f, e in product(_FIELDS, _EMPTY)] + [(f"{f}: {p}", "clean") for f, p in product(_FIELDS, _PEOPLE)]
    return out
