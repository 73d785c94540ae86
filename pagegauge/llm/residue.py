"""Template residue, filler, error messages and script notices in place of a page's content.

Labelled exemplars are held in an inverted index (term to exemplars).  Each sentence window of a
page's main body retrieves exemplars through it and is covered when the TF-IDF weight of its terms
that lie in one exemplar reaches ``CONTAINMENT`` of the window's weight.  An unfilled placeholder is
a term of the index with the weight of ``SLOT_WORDS`` words, since the sentence around it counts as
unfilled.  A page is excluded when covered windows make up ``COVERAGE`` of the characters of its main
body.  Document frequencies of the exemplars' terms are counted over the rendered main bodies of all
pages; the index is bounded by the exemplar list, never by the data.

Defined results: NULL and empty pages, and pages without any visible text, are no case; headings
count only where a page has nothing else; code, formulas and table cells count as real content;
repeated rows of a fetch are one case; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.render import Block, blocks
from pagegauge.session import cut_lineage

CONTAINMENT = 0.7
COVERAGE = 0.7
#: index term of an unfilled placeholder; it stands for the words that the sentence lacks
SLOT_TERM = "⟦slot⟧"
SLOT_WORDS = 40

#: labelled passages in the words that such pages are made of, one for each kind of notice and language
EXEMPLARS: dict[str, tuple[str, ...]] = {
    "template": (
        f"{SLOT_TERM} hello hi dear and welcome to our site; thank you for your visit, we offer you the best service and products in your town for any budget, "
        "call us or send a mail with questions about your order, delivery or account; it is ready and on the way; by the team of our company, home of good work since then; "
        "read more about what people say, made for you, price from, last changed on, copyright, all rights reserved",
        f"{SLOT_TERM} hallo und willkommen bei uns; wir bieten Ihnen den besten Service in Ihrer Stadt, Fragen zu Ihrer Bestellung beantwortet unser Team am Telefon oder per Mail; das ist für Sie, seit, von, mit, auf, der, die",
        f"{SLOT_TERM} bonjour et bienvenue chez nous; notre équipe de la ville vous offre le meilleur service pour votre commande, des questions sur votre compte, écrivez ou appelez, depuis, par, avec, les, est, du, au",
        f"{SLOT_TERM} hola y bienvenido a nuestra casa; nuestro equipo de la ciudad le ofrece el mejor servicio para su pedido, preguntas sobre su cuenta, llame o escriba, desde, por, con, los, las, es, en, del",
        "insert or enter your title, name, company, description, subtitle, heading, image, link and text here",
    ),
    "filler": (
        # the passage that printers have used for centuries, and the words that generators add to it
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud "
        "exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla "
        "pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum. Vestibulum pellentesque turpis augue ornare "
        "ligula quam arcu mauris lacus risus erat tempus nunc tortor massa orci porta neque felis vero vitae viverra sapien donec praesent vivamus",
        "text blah bla asdf qwerty foo bar baz test tbd tba todo xxx",
        "This dummy, sample or placeholder text, copy, paragraph, headline or image goes here until the client, editor or marketing will send, write or add the real one; "
        "replace, delete, add or describe it with an image and a description of it in a few or two or three short lines before you publish or launch the page; your section title, your offer or service, your new, untitled page comes or is coming soon",
        "Blindtext, Beispieltext, Platzhalter oder Mustertext: hier steht, folgt oder kommt später Ihr Text, Titel oder Bild; bitte vor der Veröffentlichung ersetzen oder löschen",
        "Texte d’exemple, faux texte ou contenu provisoire: votre texte, titre ou image ici; à remplacer ou supprimer avant la publication, merci de modifier",
        "Texto de ejemplo, relleno o contenido provisional: aquí va o escriba su texto, título o imagen; sustituir, cambiar o borrar antes de publicar",
    ),
    "error": (
        "Page, address, link or file not found, error code: the page that you requested, asked for, followed or are looking for does not exist, was never here, was moved, deleted or is gone, "
        "may be broken or could not be found on this server; nothing lives or is at this url, we looked everywhere but it is missing; check the spelling, search or go back to the home or start page",
        "Internal server error, oops, whoops, sorry, something went wrong: an unexpected error, problem or condition occurred or was met or encountered while the page or article was being loaded, "
        "the server could not complete or process your request; please try again, retry, reload or report this problem with its reference id or code in a few minutes or later",
        "Bad gateway, gateway timeout, service temporarily unavailable, overloaded: the upstream host or server did not answer, respond or connect in time; ray id",
        "The site is down, offline or closed for scheduled maintenance: we are working on, updating and improving things and will be back online soon or shortly, in a few minutes; thank you for your patience",
        "Too many requests, rate limit exceeded: slow down please, your address or client has sent more requests in a minute than allowed; wait and try again",
        "Your session, login or token has expired or ended or timed out: log in or sign in again to continue",
        "This account, site or domain has been or was suspended or disabled: contact the owner, support or your hosting provider or company for details and more information",
        "Access denied, forbidden, unauthorized: you do not have or don’t have the permission or are not allowed or authorized to view, see, open or access this page, resource, file or server",
        "This item, entry, listing, article, offer, video or content has expired, is no longer available, was removed or taken down or is not or unavailable in your area, region or country; sorry, no results were found",
        "Error establishing a database connection or link: could not connect to the database, store or host on port at line",
        "Warning, notice, fatal error, exception, traceback: undefined variable, index, function or method, uncaught exception of type error thrown or raised, failed in file app core view srv var www lib inc php py js on line at main, call stack trace, null pointer",
        "Seite nicht gefunden, Fehler, Fehlercode: die gesuchte, gewünschte oder aufgerufene Seite oder Adresse gibt es nicht oder nicht mehr, wurde verschoben, entfernt oder gelöscht; prüfen Sie die Adresse oder gehen Sie zurück zur Startseite",
        "Wartung, Wartungsarbeiten: wir arbeiten gerade an dem oder am Server, die Seite ist vorübergehend nicht erreichbar; wir sind gleich, bald, in Kürze wieder da oder zurück, danke für Ihre Geduld",
        "Interner Serverfehler, Fehler: leider ist etwas schiefgelaufen oder ein unerwarteter Fehler aufgetreten; der Server oder Dienst konnte die oder Ihre Anfrage nicht bearbeiten oder beantworten; bitte versuchen Sie es später, in einigen Minuten, noch einmal oder erneut, Kennung, Code",
        "Zugriff oder Zugang verweigert, verboten, gesperrt: Sie haben keine oder nicht die Berechtigung oder Rechte, diese Seite oder Datei zu sehen, öffnen oder aufzurufen; Sitzung abgelaufen, melden Sie sich bitte wieder an",
        "Page introuvable ou non trouvée, erreur, code: la page ou l’adresse demandée ou recherchée n’existe pas ou plus, a été déplacée ou supprimée; vérifiez l’adresse ou retournez à l’accueil",
        "Maintenance en cours: le site ou le service est momentanément indisponible, nous travaillons et il revient bientôt, dans quelques minutes ou instants; merci de patienter ou de votre patience",
        "Erreur interne du serveur, désolé: une erreur inattendue est survenue ou s’est produite, un problème; le serveur n’a pas pu traiter ou répondre à la ou votre demande ou requête; veuillez ou merci de réessayer plus tard, référence, code",
        "Accès refusé ou interdit: vous n’avez pas ou n’êtes pas le droit, la permission ou l’autorisation, autorisé, de consulter, voir ou d’accéder à cette page ou ressource; session expirée, connectez-vous de nouveau",
        "Página no encontrada, error, código: la página o dirección solicitada o buscada no existe o ya no existe, fue o ha sido movida, retirada o eliminada; compruebe la dirección o vuelva al inicio",
        "En mantenimiento: el sitio o servicio no está disponible por ahora o temporalmente, estamos trabajando y volvemos o volveremos pronto, en unos o pocos minutos; gracias por su paciencia",
        "Error interno del servidor, lo sentimos: algo salió o ha ido mal, se produjo o ha ocurrido un error o problema inesperado; el servidor no pudo completar, procesar o responder a la o su solicitud o petición; inténtelo o intente de nuevo más tarde, referencia, código",
        "Acceso denegado o prohibido: no tiene o usted no cuenta con permiso, autorización o derecho para ver, abrir o acceder a esta página o recurso; la sesión ha caducado, inicie sesión de nuevo",
    ),
    "scripts": (
        "Please activate, enable, allow, switch on or turn on JavaScript or scripts in your browser settings and reload to view, see, use, run, read or continue to this page, app, site or content; you need it or it is required; "
        "JavaScript is or seems disabled, off or blocked; your browser does not support or has blocked the scripts or script that this page, app or site needs or requires; it works or runs only with scripts switched on, not without",
        "One or just a moment, loading, please wait: we are checking or verifying your browser or connection before you access the site, that it supports scripts and cookies; if nothing happens, allow scripts for this site",
        "Bitte aktivieren oder erlauben Sie JavaScript in Ihrem Browser, um die oder diese Seite, App oder den Inhalt zu sehen, anzuzeigen oder zu nutzen; JavaScript ist deaktiviert; ohne Skripte oder JavaScript kann oder wird der oder dieser Inhalt nicht angezeigt werden oder funktioniert nicht; diese Seite benötigt, braucht Skripte; einen Moment, wird geladen",
        "Veuillez ou merci d’activer ou d’autoriser JavaScript dans votre navigateur pour afficher, voir, lire, utiliser ou continuer vers cette page, application ou ce contenu ou site; JavaScript est désactivé; cette page ou ce site ne fonctionne pas sans scripts ou JavaScript, nécessite; un instant, chargement",
        "Active, habilite o permita JavaScript en su o el navegador para ver, usar, leer o continuar en esta página, aplicación, sitio o el contenido; JavaScript está desactivado; el contenido o la página no se muestra o funciona sin scripts o JavaScript, necesita, requiere; un momento, cargando, por favor",
    ),
}

_NAME = r"[A-Za-z_][\w.\- ]{0,40}?"
_SLOT = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\{{%[^%\n]{{1,60}}%\}}|<%=?[^%\n]{{1,60}}%>|\$\{{\s*{_NAME}\s*\}}|\[\[\s*{_NAME}\s*\]\]"
    r"|\{[A-Za-z_][\w.]{1,40}\}|%[A-Za-z_][\w.]{1,40}%|#[A-Za-z_][\w.]{1,40}#|__[A-Za-z][A-Za-z0-9.]*(?:_[A-Za-z0-9.]+)*__"
    r"|\[insert [^\]\n]{1,60}\]|\[(?!sic\])[A-Za-z_][\w.]{2,40}\]|«[A-Za-z_][\w.]{2,40}»|<[A-Za-z_][\w.]{2,40}>|@@[A-Za-z_][\w.]{1,40}@@"
)
_WORD = re.compile(r"[^\W_]+")
_SENTENCE_MARK = re.compile(r"[.!?…。！？:](?:\s|$)")
#: signs without which a text holds no placeholder
_MARK = re.compile(r"[{%\[$«<#@⟦]|__")
_WINDOW = re.compile(r"(?<=[.!?…。！？])\s+|\n+|\s\|\s")


def terms(text: str) -> list[str]:
    """Lower-case words without those that hold a digit; a placeholder is one term."""
    found: list[str] = []
    if _MARK.search(text):
        found = [SLOT_TERM] * (len(_SLOT.findall(text)) + text.count(SLOT_TERM))
        text = _SLOT.sub(" ", text.replace(SLOT_TERM, " "))
    return found + [w for w in _WORD.findall(text.lower()) if w.isalpha() and (len(w) > 1 or ord(w[0]) > 0x2E80)]


class ExemplarIndex:
    """Inverted index over the labelled exemplars, with the inverse document frequency of their terms."""

    def __init__(self, exemplars: dict[str, tuple[str, ...]] = EXEMPLARS, counts: dict[str, int] | None = None, total: int = 0) -> None:
        self.labels: list[str] = []
        self.postings: dict[str, list[int]] = {}
        for label, texts in exemplars.items():
            for text in texts:
                for term in sorted(set(terms(text))):
                    self.postings.setdefault(term, []).append(len(self.labels))
                self.labels.append(label)
        counts = counts or {}
        self.unknown = math.log(1 + total) + 1
        # +1 as a floor, so that a term of every page still weighs something
        self.weight = {t: math.log((1 + total) / (1 + counts.get(t, 0))) + 1 for t in self.postings}
        self.weight[SLOT_TERM] = SLOT_WORDS * self.unknown

    def best(self, window: str) -> tuple[float, str]:
        """TF-IDF containment of the window in its best exemplar, and that exemplar's label."""
        score: dict[int, float] = {}
        total = 0.0
        for term in terms(window):
            posting = self.postings.get(term)
            if posting is None:
                total += self.unknown
                continue
            w = self.weight[term]
            total += w
            for e in posting:
                score[e] = score.get(e, 0.0) + w
        if not score:
            return 0.0, ""
        e = max(score, key=lambda x: (score[x], -x))
        return score[e] / total, self.labels[e]

    def most(self, window: str) -> float:
        """What ``best`` gives at most, whatever the document frequencies are."""
        held: dict[int, int] = {}
        unknown = 0
        for term in terms(window):
            posting = self.postings.get(term)
            if posting is None:
                unknown += 1
            elif term == SLOT_TERM:
                return 1.0
            else:
                for e in posting:
                    held[e] = held.get(e, 0) + 1
        most = max(held.values(), default=0)
        return most / (most + unknown) if most else 0.0


def _body(found: list[Block]) -> list[Block]:
    body = [b for b in found if b.kind != "heading"]
    if not body:
        return found
    if len(body) > 1 and body[0].kind == "paragraph" and not _SENTENCE_MARK.search(body[0].text):
        return body[1:]  # a title without heading tags
    return body


def covered_label(found: list[Block], value: Callable[[str], tuple[float, str]], containment: float = CONTAINMENT, coverage: float = COVERAGE) -> str | None:
    """The label of most of the residue, or None for a page with real content; ``value`` gives containment and label of a window."""
    body = _body(found)
    total = sum(len(b.text) for b in body)
    if not total:
        return None
    allowed = (1 - coverage) * total
    missed = 0
    share: dict[str, int] = {}
    for b in body:
        if b.kind in ("code", "cell", "formula"):
            missed += len(b.text)
        else:
            for window in _WINDOW.split(b.text):
                if not window or window.isspace():
                    continue
                held, label = value(window)
                if held >= containment:
                    share[label] = share.get(label, 0) + len(window)
                else:
                    missed += len(window)
                if missed > allowed:
                    return None
        if missed > allowed:
            return None
    return max(share, key=lambda x: (share[x], x)) if share else None


def residue_label(found: list[Block], index: ExemplarIndex) -> str | None:
    return covered_label(found, index.best)


def may_be_residue(found: list[Block], index: ExemplarIndex) -> bool:
    """Whether the page can be residue under some document frequencies; False is final."""
    return covered_label(found, lambda window: (index.most(window), "any")) is not None


_SCANNED = "fetch_id bigint, body binary, leads array<string>, term string, n bigint"


def scan(fetches: DataFrame, leads: Callable[[str, list[Block]], list[str] | None] | None = None) -> tuple[DataFrame, ExemplarIndex]:
    """(fetch_id, body, leads) and the index fitted on all pages, from one pass that renders every page once.

    Pages that no document frequencies can make residue keep no body; the few others keep their blocks
    until the frequencies are known.  ``leads`` gives what else is wanted of each page.  Document
    frequencies are counted over the rendered main bodies of all rows, added up before they are shuffled.
    """
    plain = ExemplarIndex()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = plain.postings.keys()
        for part in parts:
            rows: list[tuple] = []
            counts: dict[str, int] = {}
            for fetch_id, html in zip(part["fetch_id"], part["html"]):
                found = blocks(html, True)
                words: set[str] = set()
                for b in found:
                    words.update(terms(b.text))
                for term in words & vocabulary:
                    counts[term] = counts.get(term, 0) + 1
                wanted = leads(html, found) if leads is not None else None
                if may_be_residue(found, plain):
                    rows.append((fetch_id, zlib.compress(json.dumps([(b.kind, b.text) for b in found]).encode(), 1), wanted, None, None))
                elif wanted:
                    rows.append((fetch_id, None, wanted, None, None))
            counts[""] = len(part)
            rows.extend((None, None, None, term, n) for term, n in counts.items())
            yield pd.DataFrame(rows, columns=["fetch_id", "body", "leads", "term", "n"]).astype({"fetch_id": "Int64", "n": "Int64"})

    pages = fetches.select("fetch_id", "html").where(F.col("fetch_id").isNotNull() & (F.length("html") > 0))
    scanned = cut_lineage(pages.mapInPandas(run, _SCANNED))
    counted = scanned.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in counted.collect()}  # at most one row for each exemplar term
    index = ExemplarIndex(EXEMPLARS, counts, counts.pop("", 0))
    return scanned.where(F.col("term").isNull()).select("fetch_id", "body", "leads"), index


def judged(scanned: DataFrame, index: ExemplarIndex) -> DataFrame:
    """(fetch_id, leads, label) of the pages that kept their body; label is NULL for real content."""

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            labels = [residue_label([Block(kind, text) for kind, text in json.loads(zlib.decompress(body))], index) for body in part["body"]]
            yield pd.DataFrame({"fetch_id": part["fetch_id"], "leads": part["leads"], "label": pd.Series(labels, dtype="object")})

    return scanned.where(F.col("body").isNotNull()).mapInPandas(judge, "fetch_id bigint, leads array<string>, label string")


def residue_pages(fetches: DataFrame) -> DataFrame:
    """(fetch_id, label) of the fetches whose main body is residue."""
    return judged(*scan(fetches)).where("label IS NOT NULL").select("fetch_id", "label").distinct()
