"""Template residue, filler, error pages and script notices in texts.

Character n-gram models of filler, error messages, script notices and natural prose are
fitted in rounds. The first compares short seeds of each kind with the n-grams of all
texts; what it finds is counted as residue, the rest as prose, over all texts, and
the next round compares these. Residue is localised by
likelihood-ratio windows over the segments of a text: filler counts wherever a
window of content is filler or, whatever its words are, only repeats itself; error messages and script notices only when they cover the
content as a whole. Quotations are taken out first, and so are titles and menus.

Template fields are marks such as ``{{name}}`` or ``[enter date]``. Their form only proposes
them; two more models decide. One is of windows around marks in texts that explain, search or
execute marks, the other of windows around marks that stand where natural prose has a value, helped by the
model of prose. Both begin with seeds and learn from the clear windows of all texts. A mark
counts as open unless its window is likelier under the first model, or it is inside a quotation.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlake.session import Scratch, spread


NGRAM = 4
#: Buckets of hashed n-grams; the whole of each fitted table, whatever the number of texts.
BITS = 17
BUCKETS = 1 << BITS
#: Odd multipliers of the characters of an n-gram.
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x5BD1E995)
#: Bytes of text that a task works on at a time.
PIECE = 2_000_000
#: N-grams per window, about.
WINDOW = 64
#: Weight of the background in a class model, in n-grams.
SMOOTHING = 400.0
#: Mean log ratio above which a window is residue: of notices in the first round and after it, and of filler.
FIRST_RATIO, RATIO, FILLER_RATIO = 1.0, 0.4, 0.7
#: The same of a message without a sentence, in a text of titles and menus.
ALONE_RATIO = 2.0
#: Share of content from which on a text teaches what notices look like, by all of its content.
TEACHES = 0.45
#: Share of the content that error messages and notices must cover.
COVERAGE = 0.6
#: Least filler of a text that counts, in n-grams.
FILLER_LENGTH = 10
#: Share of distinct n-grams up to which a window of letters only repeats itself, and its least length in n-grams.
REPEATED, REPEATED_LENGTH = 0.35, 18
#: Least share of letters in such a window.
REPEATED_LETTERS = 0.6

#: Characters kept around the marks of a sentence; weight of the seeds (and, at most, of the texts) in their models, in n-grams.
REACH, MARK_WEIGHT = 60, 4000.0
#: Background in both models of marks, in n-grams, and share of prose in that of open fields.
MARK_SMOOTHING, PROSE_SHARE = 2000.0, 0.5
#: Largest log ratio of an n-gram; n-grams that hold a mark count double.
MARK_CLIP = 3.0
#: Summed log ratio beyond which a window teaches.
MARK_TEACHES = 10.0
#: Sizes of their n-grams; each has buckets of its own.
MARK_NGRAMS = (NGRAM, 6)
MARK_BUCKETS = BUCKETS * len(MARK_NGRAMS)
#: Summed log ratio up to which a mark counts as open.
MARK_RATIO = 2.0
#: Stands for a mark.
MARK = "\x00"

KINDS = ("filler", "error", "script")
MARK_KINDS = ("mention", "open")

# Seeds of the first round.
SEEDS = {
    "filler": """Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
This is dummy text for the layout. Placeholder text, replace it with your own text. Your headline here. Your text goes here.
Sample text sample text sample text. Test test test test. Text text text text. Filler filler filler. Blah blah blah. asdf asdf jkl asdf. qwerty qwerty. Write a few words about yourself here. Tell your visitors about your business. Add a description here. This is a default entry, edit or delete it.
Dies ist ein Blindtext. Blindtext Blindtext Blindtext. Hier steht später Ihr Text. Mustertext für das Layout, bitte ersetzen. Platzhaltertext.
Ceci est un texte d'exemple. Faux texte pour la maquette, à remplacer. Votre titre ici. Paragraphe d'exemple.
Este es un texto de relleno. Texto de ejemplo para la maqueta, cámbielo por el suyo. Su título aquí. Párrafo de ejemplo.
これはダミーテキストです。ここに文章が入ります。サンプルテキスト。ここに見出しを入力してください。""",
    "error": """404 Not Found. The page you requested could not be found. This page does not exist. The link may be broken. Page not found. Check the address.
500 Internal Server Error. An unexpected error occurred. Something went wrong. Please try again later. 503 Service Unavailable. 502 Bad Gateway.
403 Forbidden. Access denied. You do not have permission to view this page. Your session has expired. Please log in again. Too many requests.
The server did not respond. 504 Gateway Timeout. The request timed out. Could not connect to the database. Request ID: 0. Error code: 0. Reference 0.
Sorry, we can't show this page right now. Oops! The site is down for maintenance. We will be back soon. Go back to the home page. Contact support.
Traceback (most recent call last): File "app.py", line 0, in handle raise err KeyError: RuntimeError: TimeoutError: Exception
Fehler 404. Die angeforderte Seite wurde nicht gefunden. Zugriff verweigert. Ein interner Fehler ist aufgetreten. Der Dienst ist zurzeit nicht verfügbar. Wegen Wartung geschlossen. Bitte versuchen Sie es später erneut.
Erreur 404. La page demandée est introuvable. Accès refusé. Une erreur interne est survenue. Le service est indisponible. Site en maintenance. Veuillez réessayer plus tard.
Error 404. No se encuentra la página solicitada. Acceso denegado. Se produjo un error interno. El servicio no está disponible. Sitio en mantenimiento. Inténtelo de nuevo más tarde.
お探しのページは見つかりませんでした。アクセスが拒否されました。内部エラーが発生しました。サービスは現在利用できません。ただいまメンテナンス中です。しばらくしてからもう一度お試しください。""",
    "script": """Please enable JavaScript to view this page. JavaScript is disabled in your browser. This site requires JavaScript. You need to enable JavaScript to run this app.
Turn on JavaScript in your browser settings and reload the page. This page needs scripts. Your browser blocks scripts; allow them to continue. Noscript: enable JS.
We're sorry but this app doesn't work properly without JavaScript enabled. Scripting is switched off. Activate scripts and refresh. Please allow scripts to sign in.
Bitte aktivieren Sie JavaScript, um diese Seite zu sehen. Diese Ansicht benötigt Skripte. Bitte im Browser erlauben und neu laden. Ohne JavaScript kann die Seite nicht angezeigt werden.
Veuillez activer JavaScript pour afficher cette page. Cette page a besoin de scripts. Autorisez-les dans le navigateur. Sans JavaScript, la page ne peut pas s'afficher.
Active JavaScript para ver esta página. Esta página necesita scripts. Permítalos en el navegador y recargue. Sin JavaScript no se puede mostrar la página.
このページを表示するにはJavaScriptを有効にしてください。スクリプトが無効になっています。スクリプトが無効なため、このページは表示できません。ブラウザの設定でスクリプトを許可してください。""",
}

# Seeds of the models of marks, each ¤ a mark; sentences end as in prose or at " ; ".
MARK_SEEDS = {
    "mention": r"""The tag ¤ inserts the name of the customer. Use ¤ in the text of the mail to insert the number. Put ¤ where the address should appear.
The variable ¤ holds the name of the user. The placeholder ¤ stands for the title. The field ¤ is filled from the database when the mail is sent.
¤ is replaced by the current date. Each ¤ will be replaced with the right value. ¤ becomes the number of the page. ¤ expands to the name of the file.
Replace ¤ with your own user name. Change ¤ to the path of your folder before you run the command. Write ¤ in the header and the program inserts the value.
Someone asked what ¤ means: it is a field of the mail program. What is ¤ for? The token ¤ tells the system where the signature goes.
We searched the letters for ¤ and found three. A script checks every file for ¤ and reports it. The test fails if a page still contains ¤. The tool scans the documents for ¤.
The syntax ¤ is supported, ¤ is not. The old form ¤ was dropped; write ¤ instead. Both ¤ and ¤ are allowed. Only ¤ is understood by the parser. Do not edit ¤ yourself, the build step sets it.
The manual gives ¤ as an example of a merge field. The documentation describes ¤ and ¤. For example, ¤ prints the date. Such as ¤ in a template. Fields like ¤ are set by the editor.
A literal ¤ has to be escaped with a backslash. The parser treats ¤ as plain text. The template engine reads ¤ as a variable. In the template, ¤ marks the place of the price. The name in ¤ must match the column.
If the output still shows ¤, the variable was not defined. The bug left ¤ in the subject line. The log shows ¤ because the key was missing. He noticed that the poster said ¤ and had it printed again. The draft still had ¤ in it.
Enter ¤ and press the button. Type ¤ into the box to see the result. Copy ¤ into the form. When you export, ¤ turns into the text. An expression like ¤ is evaluated later. The string ¤ is not translated.
Die Variable ¤ steht für den Namen. Der Platzhalter ¤ wird beim Senden durch das Datum ersetzt. Ersetzen Sie ¤ durch Ihren Namen. Das Feld ¤ füllt das Programm aus. Schreiben Sie ¤ in die Vorlage. Mit ¤ fügt man die Anschrift ein. In der Anleitung ist ¤ ein Beispiel. Was bedeutet ¤? Der Ausdruck ¤ wird ausgewertet. Die Marke ¤ bleibt stehen, wenn der Wert fehlt. Die Schreibweise ¤ gilt noch. Wer ¤ eingibt, erhält den Wert.
La variable ¤ contient le nom du client. Le champ ¤ est remplacé par la date. Remplacez ¤ par votre nom. La balise ¤ insère le titre. Écrivez ¤ dans le modèle à la place du prix. Que signifie ¤ ? Le mot ¤ sert d'exemple dans le manuel. L'expression ¤ sera évaluée à l'envoi. On met ¤ là où le texte doit apparaître. Le programme remplit ¤ avec la valeur.
La variable ¤ contiene el nombre del cliente. El campo ¤ se sustituye por la fecha. Reemplace ¤ por su nombre. La etiqueta ¤ inserta el título. Escriba ¤ en la plantilla en lugar del precio. ¿Qué significa ¤? El manual pone ¤ como ejemplo. El programa cambia ¤ por el valor. Ponga ¤ donde deba ir el texto. La expresión ¤ se evalúa al enviar.
変数¤には名前が入ります。¤は送信時に日付に置き換えられます。¤を自分の名前に置き換えてください。テンプレートの¤は差し込み欄です。¤と書くと値が表示されます。¤というタグを使います。¤の意味は何ですか。説明書では¤を例に挙げています。
for x in ¤; do echo "¤"; done ; if [ -z "¤" ]; then exit 0; fi ; cp -r ¤ /tmp/backup && rm ¤ ; export PATH=¤:/usr/bin ; cat ¤ | grep -v "¤" > out.txt
print("¤") ; value = config.get("¤") ; const url = `https://host/¤/items?id=¤`; return ¤; if (¤ == null) { ¤ } ; def name(self): return f"¤" ; SELECT ¤ FROM table WHERE id = ¤;
run --input ¤ --output ¤ ; docker run -v ¤:/data image ; git clone ¤ ; ssh ¤@host ; curl -H "token: ¤" https://host/¤ ; sed 's/¤/0/g' file.txt ; console.log(¤); logger.warn("no value for ¤")
0 info template ¤ rendered ; warn unresolved variable ¤ ; error: KeyError ¤ ; <a href="¤"> ; <img src="¤" alt="¤"> ; {"name": "¤", "id": "¤"} ; x = "¤" % y
There are three kinds of variables: ¤, ¤ and ¤. The tokens ¤, ¤ and ¤ mean the same. Inside ¤ you can use a function. Words between the brackets, as in ¤, are names of columns.
for file in ¤/*.txt; do cat "$file"; done ; mkdir -p ¤/out && tar -xf ¤.tar ; echo "Dear ¤" > mail.txt ; let text = `Dear ¤, you have ¤ mails`; ; const x = "¤" + y; ; docker build -t ¤:0 . ; pip install ¤ ; printf("Hello %s", ¤); ; System.out.println("Hello " + ¤); ; message = "Dear ¤" ; echo ¤ >> log.txt ; ls -la ¤ | wc -l ; mv ¤ ¤ && cd .. ; rm -rf ¤/* ; chmod 0 ¤ ; scp ¤ ¤:¤ ; make -C ¤ install ; assert f("¤") == "0" ; return `¤ ¤`.length; ; map.put("¤", ¤); ; list[¤] = ¤.get(0) ; var a = `¤`; ; throw new Error(`no ¤`); ; return ¤ + "0"; ; <p>Hello ¤</p> ; 0 error: could not read ¤ ; fatal: ¤ not set
Why does ¤ stay empty? The editor shows ¤ in red. My colleague removed ¤ from the file. The system knows ¤ and ¤. With ¤ you get the link. The pattern ¤ matches every word. Leave ¤ as it is when you translate. If the value is missing, ¤ stays empty. This section shows how ¤ works. You will learn how to use ¤ in your own pages. Nothing happens to ¤ while you edit. The page said ¤ instead of the price. The software ignores ¤ if no file is given. ¤ appears twice in the source code. Is ¤ allowed in the title too? The latest version rejects ¤.
Mit ¤ erhält man den Namen. Fehlt der Wert, bleibt ¤ leer. Im Brief stand ¤ statt des Namens. Hier lernen Sie, wie ¤ funktioniert. Das Programm ignoriert ¤ in Kommentaren. ¤ kommt im Code zweimal vor. Die neue Version versteht ¤ nicht mehr. Die Software kennt ¤ nicht. Le logiciel ne connaît pas ¤. Si la valeur manque, ¤ reste vide. Le script ignore ¤ quand il est seul. La lettre affichait ¤ au lieu du nom. On trouve ¤ deux fois dans le code. Avec ¤ on obtient le lien. El sistema no conoce ¤. Si falta el valor, ¤ queda vacío. El guion ignora ¤ cuando está solo. La carta mostraba ¤ en vez del nombre. Se encuentra ¤ dos veces en el código. Con ¤ se obtiene el enlace. 値がないと¤は空になります。文中の¤は自動で置換されます。コードに¤が二回出てきます。手紙に¤と表示されました。¤と入力すると変わります。""",
    "open": """Dear ¤, Hello ¤, thank you for your order. Hi ¤! Dear Mr ¤, your booking for ¤ is complete. Kind regards, ¤ Welcome to ¤, ¤!
Date: ¤ Name: ¤ Place: ¤ Total: ¤ Phone: ¤ Subject: ¤ Time: ¤ Number: ¤ Address: ¤ Notes: ¤ Remarks: ¤ Contact: ¤ Title: ¤ Weather: ¤, wind: ¤ # ¤ ¤ ¤
We met at ¤ on ¤ and spoke about ¤. The meeting at ¤ starts at ¤. Invoice ¤ of ¤ is due on ¤. Please call ¤ or write to ¤ if you have questions. In total ¤ visitors came to ¤. Report for ¤, written by ¤ on ¤.
This document was prepared by ¤ for ¤ and has ¤ pages. The house at ¤ has ¤ rooms. Your parcel left us on ¤ and will arrive at ¤. Next appointment: ¤ ¤ visited ¤ on ¤. We look forward to seeing you in ¤. The train from ¤ to ¤ was late.
Sehr geehrter Herr ¤, Guten Tag ¤, Ihre Bestellung vom ¤ ist da. Datum: ¤ Name: ¤ Ort: ¤ Anzahl: ¤ Am ¤ waren wir in ¤. Mit freundlichen Grüßen ¤ Bericht für ¤ vom ¤. Nächster Termin: ¤ Bitte wenden Sie sich an ¤.
Bonjour ¤, votre colis du ¤ est prêt. Date : ¤ Nom : ¤ Lieu : ¤ Nombre : ¤ Le ¤ nous étions à ¤. Cordialement, ¤ Rapport pour ¤ du ¤. Prochain rendez-vous : ¤ Merci de contacter ¤.
Hola ¤, su paquete del ¤ está listo. Fecha: ¤ Nombre: ¤ Lugar: ¤ Cantidad: ¤ El ¤ estuvimos en ¤. Un saludo, ¤ Informe de ¤ del ¤. Próxima cita: ¤ Póngase en contacto con ¤.
¤様、お世話になっております。日付:¤ 名前:¤ 場所:¤ 合計:¤ ¤に¤で会いました。¤の報告書 次回:¤ 担当:¤
Your appointment with ¤ is on ¤ at ¤. The concert in ¤ was sold out. She joined us in ¤ and works as ¤. On ¤ the team from ¤ won by ¤ goals. When we arrived at ¤ it was raining. Thank you for choosing ¤. The shop in ¤ is open from ¤ to ¤. The doors close at ¤. Price: ¤ per night. Order no. ¤ Ref. ¤ Signed, ¤
¤ has been a member since ¤. ¤ and ¤ live in ¤. ¤ wrote to us about ¤. With this letter we send you the keys of ¤. The road to ¤ is closed because of ¤. Congratulations on ¤! You have won ¤. The new owner of ¤ is ¤. He was born in ¤ on ¤. Age: ¤ years, weight: ¤ kg. Dear ¤, your order ¤ is on its way. Hello ¤, the car ¤ is ready for you. Flight ¤ is late. Hello ¤, room ¤ is free for you. Our office in ¤ was closed yesterday. Your number is ¤. My brother lives near ¤ and is a teacher. The branch in ¤ is closed on ¤. We enclose a copy of ¤ with this mail. It was a fine day and we walked to ¤. See you at ¤! This prize goes to ¤ for ¤. Mr ¤ is on holiday until ¤. I am writing to you about ¤. Please bring ¤ and be there by ¤.
Die Firma ¤ aus ¤ liefert am ¤. Wir treffen uns um ¤ in ¤. Herzlich willkommen in ¤! Ihr Termin bei ¤ ist am ¤ um ¤ Uhr. Wir haben ¤ besucht und ¤ gesehen. Rechnung Nr. ¤ Preis: ¤ Euro. Liebe ¤, danke für deinen Brief aus ¤. Das Zimmer ¤ ist frei. Die Sitzung findet am ¤ im Rathaus statt. Vielen Dank für Ihren Besuch in ¤. Der Laden in ¤ ist zu. Ihre Nummer ist ¤. Unsere Filiale in ¤ hat heute offen. Mein Bruder wohnt in ¤.
La société ¤ livre à ¤ le ¤. Bienvenue à ¤ ! Votre rendez-vous avec ¤ est le ¤ à ¤ heures. Nous avons visité ¤. Facture no ¤ Prix : ¤ euros. Chère ¤, merci pour ta lettre de ¤. La chambre ¤ est libre. La fête du ¤ se tiendra à ¤. Merci de votre visite à ¤. Votre numéro est le ¤. Mon frère habite à ¤. Madame ¤, Rendez-vous le ¤ à la gare de ¤. Le train pour ¤ part à ¤.
La empresa ¤ entrega en ¤ el ¤. ¡Bienvenido a ¤! Su cita con ¤ es el ¤ a las ¤. Hemos visitado ¤. Factura no. ¤ Precio: ¤ euros. Querida ¤, gracias por tu carta de ¤. La habitación ¤ está libre. La fiesta del ¤ será en ¤. Gracias por su visita a ¤. Su número es el ¤. Mi hermano vive en ¤. Señora ¤, La cena es el ¤ en la plaza. El tren a ¤ sale a las ¤.
¤さん、こんにちは。¤にご参加いただきありがとうございます。¤は¤で開催されます。ご注文番号:¤ 料金:¤円 人数:¤名 ¤へようこそ。¤時に¤へ行きました。¤の¤と申します。""",
}

# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁАВЕКМНОРСТХІЅοΟ", "aeopcyxijsdABEKMHOPCTXISoO")
# Characters without width, and soft hyphens.
UNSEEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
TAGS = re.compile(r"</?(?:p|div|br|li|ul|ol|b|i|em|strong|span|h[1-6]|a|pre|code|table|tr|td|th|body|html|section|article|blockquote|title|center|hr)(?:\s[^<>\n]{0,200})?/?>", re.I)

#: Marks of template syntax, whatever is in them; like WEAK, these only propose.
STRONG = re.compile(
    r"\{\{\{?[^{}\n]{1,80}\}?\}\}|\[\[[^\[\]\n]{1,80}\]\]|\$\{[^{}\n]{1,80}\}|\$\([A-Za-z][\w.\- ]{1,60}\)|<%[^<>%\n]{1,80}%>|\{%[^{}%\n]{1,80}%\}|\*\|[^|*\n]{1,60}\|\*"
    r"|\#\{[^{}\n]{1,60}\}|@\{[^{}\n]{1,60}\}|@@[^@\n]{1,60}@@|\#\#[^#\n]{1,60}\#\#|%[A-Za-z][\w.]{2,40}%|_{2,}\s?[^\W_][^_\n]{1,60}(?:_[^_\n]{1,40}){0,4}_{2,}"
    r"|\*{3,}[^*\n]{3,60}\*{3,}|\{\{\s{0,2}[\w.]{3,40}|<<[^<>\n]{2,60}>>"
)
#: Brackets that may be anything; their inside must read like a field.
WEAK = re.compile(r"\[([^\[\]\n]{3,60})\](?!\()|<([^<>\n]{3,60})>|(?<![\w$@#{])\{([^{}\n]{3,60})\}|«(?!\s)([^«»\n]{3,60})(?<!\s)»")
FIELD = re.compile(r"\s{0,4}(?:TBD:?\s{0,4})?[^\W\d_][\w.’'\-]{1,40}(?:[ ,:\-]{1,4}[\w.’'\-]{1,40}){0,9}\s{0,4}", re.I)
QUOTED = re.compile(r"(?<![\w])'[^'\n]{10,400}?'(?![\w])|(?<![\w])'[^\n]{10,400}?[.!?\w]'(?=[\s,.;:)]|$)|\"[^\"\n]{10,400}\"|“[^”\n]{10,400}”|‘[^\n]{10,400}?’(?!\w)|„[^“”\n]{10,400}[“”]|「[^」\n]{5,300}」|« [^»\n]{6,300} »")
QUOTES = re.compile("['\"“‘„「«](?<!\\w.)")
ENDS = re.compile(r"[.!?。！？…:;]['\"”’»)\]]*$")
ENDINGS = (". ", "! ", "? ", "。", "！", "？")
MOJIBAKE = re.compile("[ÃÂã]")
FOREIGN, LATIN = re.compile("[Ͱ-ӿԀ-ԯ]"), re.compile("[a-zA-Z]")
OPEN = re.compile(r"(?:\{[{%]|<%=?|\[\[|\$\{|<<|«|_{4})[^\]}>»_]{0,40}$")
MARK_STARTS = re.compile(r"[{\[<%$@*«]|__|\#[{\#]")
SEPARATORS = (",", ";", "、", " | ", " / ", " > ", " - ", " · ", " • ", " – ", " — ")
DIGITS = re.compile(r"\d[\d.,:/\-]*")


def clean(text: str) -> str:
    """The text without tags, invisible characters, look-alike letters, odd blanks and line ends, and common double encoding."""
    ascii_only = text.isascii()
    if not ascii_only and MOJIBAKE.search(text):
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    if "<" in text:
        text = TAGS.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    if not ascii_only:
        text = unicodedata.normalize("NFKC", UNSEEN.sub("", text))
        if FOREIGN.search(text) and LATIN.search(text):
            text = text.translate(LOOKALIKES)
    return "\n".join([" ".join(line.split()) for line in text.splitlines()])


def sentences(line: str) -> list[str]:
    """Sentences of a line whose blanks are single ones."""
    for end in ENDINGS:
        if end in line:
            line = line.replace(end, end[0] + "\n")
    return line.split("\n")


def is_list(line: str) -> bool:
    """Whether a line is a menu or a list of names: four or more short pieces."""
    pieces = 1 + sum(map(line.count, SEPARATORS))
    return pieces >= 4 and line.count(" ") + 1 <= 3.5 * pieces


def paragraphs(text: str) -> list[str]:
    """Lines, with hard-wrapped ones joined: a line goes on if it doesn't end a sentence and the next begins in lower case (if the text has capitals at all)."""
    out: list[str] = []
    cased = text != text.lower()
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            out.append("")
        elif out and out[-1] and (OPEN.search(out[-1][-60:]) or cased and not ENDS.search(out[-1][-6:]) and (line[0].islower() or out[-1][-1] == ",") and len(out[-1]) > 12 and not is_list(out[-1])):
            out[-1] += " " + line
        else:
            out.append(line)
    return [x for x in out if x]


def marked(line: str) -> list[str]:
    """The windows around marks of a line, one per sentence with marks outside of quotations, in lower case, each mark replaced by MARK."""
    if not MARK_STARTS.search(line):
        return []
    spans = [m.span() for m in STRONG.finditer(line)]
    spans += [m.span() for m in WEAK.finditer(line) if FIELD.fullmatch(next(g for g in m.groups() if g is not None)) and not DIGITS.search(m.group())]
    if not spans:
        return []
    parts, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            parts += [line[at:a], MARK]
            at = b
    out = []
    for sentence in sentences("".join([*parts, line[at:]])):
        if MARK in sentence and not (QUOTES.search(sentence) and any(MARK in q.group() for q in QUOTED.finditer(sentence))):
            a, b = sentence.index(MARK) - REACH, sentence.rindex(MARK) + REACH + 1
            out.append(normal(sentence[max(a, 0) : b].strip()))
    return out


def segments(line: str) -> list[tuple[str, bool]]:
    """(text; whether it is content) of a line: its sentences, or itself if it is a title or a menu.

    Quotations inside a longer sentence are left out, and quoted lines are no content of their own.
    """
    if line.startswith(">"):
        return []
    bare = line.lstrip("#-*•>0123456789.) ")
    if not bare:
        return []
    if is_list(bare) or bare.count(" ") < 8 and not ENDS.search(bare[-6:]):
        return [(bare, False)]
    if QUOTES.search(bare):
        kept = QUOTED.sub(" ", bare)
        if len(kept) < len(bare) and sum(map(str.isalpha, kept)) >= 20:
            bare = kept
    return [(s, True) for s in map(str.strip, sentences(bare)) if s]


def normal(text: str) -> str:
    """Lower case, numbers unified."""
    return DIGITS.sub("0", text.lower())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def hashed(text: str | np.ndarray, size: int = NGRAM) -> np.ndarray:
    """Bucket of each character n-gram of a text (n - 1 fewer than characters)."""
    c = codes(text) if isinstance(text, str) else text
    n = len(c) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = c[:n] * np.uint32(FACTORS[0])
    for i in range(1, size):
        h += c[i : n + i] * np.uint32(FACTORS[i])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def log_ratios(counts: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Per class and bucket, log of the class model's probability over the background's; classes are smoothed towards the background."""
    q = (background + 0.5) / (background.sum() + 0.5 * BUCKETS)
    n = counts.sum(axis=1, keepdims=True)
    return np.log((counts / q + SMOOTHING) / (n + SMOOTHING)).astype(np.float32)


def seed_counts() -> np.ndarray:
    out = np.zeros((len(KINDS), BUCKETS))
    for i, kind in enumerate(KINDS):
        for line in SEEDS[kind].split("\n"):
            for text, _ in segments(line):
                np.add.at(out[i], hashed(f" {normal(text)} "), 1)
    return out


def mark_seed_counts() -> np.ndarray:
    out = np.zeros((len(MARK_KINDS), MARK_BUCKETS))
    for i, kind in enumerate(MARK_KINDS):
        texts = [t.strip() for line in MARK_SEEDS[kind].split("\n") for part in line.split(" ; ") for t in sentences(part)]
        seeds = Marked([[normal(t).replace("¤", MARK) for t in texts]])
        np.add.at(out[i], seeds.grams[seeds.weight > 0], 1)
    return out


def mark_ratios(seeds: np.ndarray, taught: np.ndarray, prose: np.ndarray) -> np.ndarray:
    """Per bucket, log of the probability where a text speaks about marks over that where a mark stands open. seeds, taught: counts by MARK_KINDS."""
    q = np.zeros(MARK_BUCKETS)
    q[:BUCKETS] = (prose + 0.5) / (prose.sum() + 0.5 * BUCKETS)
    own = []
    for seed, more in zip(seeds, taught):
        n = min(more.sum(), MARK_WEIGHT)
        own.append((MARK_WEIGHT * seed / seed.sum() + (n * more / more.sum() if n else 0.0)) / (MARK_WEIGHT + n))
    mention, opened = own[0], (1 - PROSE_SHARE) * own[1] + PROSE_SHARE * q
    least = MARK_SMOOTHING * q + 0.3
    return np.log((MARK_WEIGHT * mention + least) / (MARK_WEIGHT * opened + least)).clip(-MARK_CLIP, MARK_CLIP).astype(np.float32)


class Marked:
    """Windows around marks of many texts, with their n-grams."""

    def __init__(self, texts: list[list[str]]):
        self.doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        flat = [w for t in texts for w in t]
        joined = codes("".join(f" {w} " for w in flat))
        lengths = np.array([len(w) + 2 for w in flat], np.int64)
        place, is_mark = np.repeat(np.arange(len(flat)), lengths), joined == ord(MARK)
        grams, weights, owners = [], [], []
        for i, size in enumerate(MARK_NGRAMS):
            grams.append(hashed(joined, size) + i * BUCKETS)
            n = len(grams[-1])
            holds = np.logical_or.reduce([is_mark[k : n + k] for k in range(size)]) if n else np.zeros(0, bool)
            # an n-gram that reaches over the end of its window belongs to none
            weights.append(np.where(place[:n] == place[size - 1 :][:n], 1.0 + holds, 0.0))
            owners.append(place[:n])
        self.grams, self.weight, self.owner = np.concatenate(grams), np.concatenate(weights), np.concatenate(owners)

    def scores(self, ratios: np.ndarray) -> np.ndarray:
        """Summed log ratio of each window: the higher, the more the text speaks about its marks."""
        return np.bincount(self.owner, ratios[self.grams] * self.weight, len(self.doc)) if len(self.grams) else np.zeros(len(self.doc))

    def counts(self, ratios: np.ndarray) -> np.ndarray:
        """n-grams of the clear windows, by MARK_KINDS."""
        score = self.scores(ratios)[self.owner]
        return np.stack([np.bincount(self.grams[clear & (self.weight > 0)], minlength=MARK_BUCKETS) for clear in (score > MARK_TEACHES, score < -MARK_TEACHES)])


class Windows:
    """Segments of many texts, cut into windows, with their n-grams."""

    def __init__(self, lines: list[str]):
        """lines: per text its segments, one per line, each after + for content or -; '' for none."""
        self.doc = np.repeat(np.arange(len(lines)), [x.count("\n") + 1 if x else 0 for x in lines])
        self.joined = "\n".join(x for x in lines if x) + "\n" if len(self.doc) else ""
        chars = codes(self.joined).copy()
        ends = np.flatnonzero(chars == ord("\n"))
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        self.content = chars[starts] == ord("+")
        # the sign before a segment and the end of its line become the blanks around it
        chars[starts] = chars[ends] = ord(" ")
        self.grams = hashed(chars)
        lengths = ends + 1 - starts
        size = np.maximum(lengths - NGRAM + 1, 0)
        n = np.maximum(1, -(-size // WINDOW))
        self.segment = np.repeat(np.arange(len(ends)), n)
        k = np.arange(len(self.segment)) - np.repeat(np.cumsum(n) - n, n)
        size_w, n_w = size[self.segment], n[self.segment]
        self.start = starts[self.segment] + size_w * k // n_w
        self.end = starts[self.segment] + size_w * (k + 1) // n_w
        self.length = self.end - self.start

    def within(self) -> np.ndarray:
        """The n-grams of all windows, one window after the other."""
        before = np.cumsum(self.length) - self.length
        return self.grams[np.arange(self.length.sum()) + np.repeat(self.start - before, self.length)]

    def repeated(self) -> np.ndarray:
        """Whether each window only repeats itself: few distinct n-grams, mostly letters."""
        out = np.zeros(len(self.start), bool)
        at = np.flatnonzero(self.length >= REPEATED_LENGTH)
        if not len(at):
            return out
        # shorter windows are filled up with their last n-gram, which adds no distinct one
        grams = self.grams[np.minimum(self.start[at, None] + np.arange(WINDOW), self.end[at, None] - 1)].astype(np.int32)
        grams.sort(axis=1)
        distinct = 1 + (grams[:, 1:] != grams[:, :-1]).sum(axis=1)
        for i in at[distinct <= REPEATED * self.length[at]]:
            w = self.joined[self.start[i] : self.end[i] + NGRAM - 1].strip("+-\n ")
            out[i] = sum(map(str.isalpha, w)) >= REPEATED_LETTERS * len(w)
        return out

    def means(self, ratios: np.ndarray) -> np.ndarray:
        """Mean log ratio per class and window."""
        edges = np.stack([self.start, self.end], axis=1).ravel()
        out = np.zeros((len(ratios), len(self.start)))
        for i, r in enumerate(ratios):
            total = np.add.reduceat(np.append(r[self.grams], np.float32(0)), edges)[::2]
            out[i] = np.where(self.length > 0, total / np.maximum(self.length, 1), 0.0)
        return out


def parse(text: str | None) -> tuple[list[tuple[str, bool]], list[str]]:
    """Segments of a text, and the windows around its marks."""
    if not text:
        return [], []
    text = clean(text)
    lines = paragraphs(text)
    return [s for line in lines for s in segments(line)], [w for line in lines for w in marked(line)] if MARK_STARTS.search(text) else []


def judge(windows: Windows, ratios: np.ndarray, limit: float, docs: int, repeats: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window its kind (-1 none); per text whether it has filler, and the share of its content that is error message or notice."""
    if not len(windows.segment):
        return np.empty(0, np.int64), np.zeros(docs, bool), np.zeros(docs)
    means = windows.means(ratios)
    kind, best = np.argmax(means, axis=0), np.max(means, axis=0)
    content, doc = windows.content[windows.segment], windows.doc[windows.segment]
    # what is not a sentence must be clearer
    least = np.where(kind == 0, FILLER_RATIO, limit) + np.where(content, 0.0, 0.5)
    kind = np.where((windows.length > 0) & (best > least), kind, -1)
    if repeats:
        kind[windows.repeated()] = 0
    filler = np.bincount(doc, np.where(kind == 0, windows.length, 0), docs) >= FILLER_LENGTH
    # titles and menus count only where a text has nothing else, and then one clear message is enough
    size = np.where(content, windows.length, 0)
    whole = np.bincount(doc, size, docs)
    share = np.divide(np.bincount(doc, np.where(kind >= 1, size, 0), docs), whole, out=np.zeros(docs), where=whole > 0)
    alone = np.bincount(doc, (kind >= 1) & ~content & (best > ALONE_RATIO), docs) > 0
    return kind, filler, np.where((whole == 0) & alone, 1.0, share)


def taught(windows: Windows, ratios: np.ndarray, limit: float, docs: int) -> np.ndarray:
    """What each window is counted as in the next round: texts largely covered by notices are notices, notices elsewhere are prose."""
    kind, _, share = judge(windows, ratios, limit, docs, repeats=False)  # repeated words teach nothing about other filler
    if not len(kind):
        return kind
    doc = windows.doc[windows.segment]
    script = np.bincount(doc, np.where(kind == 2, windows.length, 0), docs) > np.bincount(doc, np.where(kind == 1, windows.length, 0), docs)
    notice = np.where(script, 2, 1)[doc]
    return np.where(kind == 0, 0, np.where((share[doc] >= TEACHES) & windows.content[windows.segment], notice, -1))


def parsed(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, marks, segments): each text read once; windows around marks one per line; segments one per line, after + for content or -."""
    kind = documents.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1):
            read = [parse(t) for t in batch.column(1).to_pylist()]
            lines = [normal("\n".join(("+" if content else "-") + s for s, content in segs)) for segs, _ in read]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["\n".join(m) for _, m in read], pa.string()), pa.array(lines, pa.string())], names=[ident, "marks", "segments"])

    return spread(documents.select(ident, text)).mapInArrow(run, f"`{ident}` {kind}, marks string, segments string")


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut by the size of their texts, so that memory follows PIECE and the longest text, not the rows of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        piece = (np.cumsum(size) - size) // PIECE
        starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def _marked(lines: list[str]) -> Marked:
    return Marked([x.split("\n") if x else [] for x in lines])


@dataclass
class Models:
    """Fitted tables: log ratios of KINDS to prose, and of the two models of marks."""

    kinds: np.ndarray
    marks: np.ndarray


def _gram_counts(texts: DataFrame, models: Models | None, limit: float = RATIO) -> DataFrame:
    """(kind, bucket, n) over all texts: KINDS, then MARK_KINDS, then prose. Without models everything is prose."""
    rows = len(KINDS) + len(MARK_KINDS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((rows, MARK_BUCKETS), np.int64)
        for batch in _pieces(batches, 0):
            lines = batch.column(0).to_pylist()
            if models is None:
                counts[-1, :BUCKETS] += np.bincount(Windows(lines).grams, minlength=BUCKETS)
                continue
            counts[len(KINDS) : -1] += _marked(batch.column(1).to_pylist()).counts(models.marks)
            windows = Windows(lines)
            if not len(windows.segment):
                continue
            kind = taught(windows, models.kinds, limit, batch.num_rows)
            owner = np.repeat(np.where(kind < 0, len(KINDS), kind), windows.length)
            found = np.bincount(owner * BUCKETS + windows.within(), minlength=(len(KINDS) + 1) * BUCKETS).reshape(-1, BUCKETS)
            counts[: len(KINDS), :BUCKETS] += found[:-1]
            counts[-1, :BUCKETS] += found[-1]
        kinds, buckets = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(buckets.astype(np.int32)), pa.array(counts[kinds, buckets])], names=["kind", "bucket", "n"])

    found = texts.select("segments", "marks").mapInArrow(run, "kind int, bucket int, n bigint")
    return found.groupBy("kind", "bucket").agg(F.sum("n").alias("n"))


def _collect(counted: DataFrame) -> np.ndarray:
    """The fitted tables, of a size fixed by BUCKETS."""
    table = counted.toPandas()
    out = np.zeros((len(KINDS) + len(MARK_KINDS) + 1, MARK_BUCKETS))
    out[table["kind"].to_numpy(), table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def fit(texts: DataFrame, rounds: int = 3) -> Models:
    """Models of the last round, fitted on all texts (a table of ``parsed``)."""
    k, seeds, marks = len(KINDS), seed_counts(), mark_seed_counts()
    prose = _collect(_gram_counts(texts, None))[-1, :BUCKETS]
    models = Models(log_ratios(seeds, prose), mark_ratios(marks, np.zeros_like(marks), prose))
    for i in range(1, rounds):
        counts = _collect(_gram_counts(texts, models, RATIO if i > 1 else FIRST_RATIO))
        prose = counts[-1, :BUCKETS]
        models = Models(log_ratios(counts[:k, :BUCKETS] + seeds, prose + 1e-3 * seeds.sum(axis=0)), mark_ratios(marks, counts[k:-1], prose))
    return models


def find_residue(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, template, filler, notice_share, residue) of every document.

    template: has an unfilled field. filler: has filler where content belongs.
    notice_share: share of the content that is error message or script notice. residue:
    any of the three (the share at least COVERAGE). Null and empty texts have none; rows of equal id count once
    (residue if any of them has it). Whole texts are read.
    """
    texts = Scratch(documents.sparkSession).write(parsed(documents, ident, text), "parsed")
    models = fit(texts)
    kind = documents.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 2):
            marks = _marked(batch.column(1).to_pylist())
            template = np.bincount(marks.doc, marks.scores(models.marks) <= MARK_RATIO, batch.num_rows) > 0
            _, filler, share = judge(Windows(batch.column(2).to_pylist()), models.kinds, RATIO, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(template), pa.array(filler), pa.array(share), pa.array(template | filler | (share >= COVERAGE))], names=[ident, "template", "filler", "notice_share", "residue"])

    rows = texts.mapInArrow(run, f"`{ident}` {kind}, template boolean, filler boolean, notice_share double, residue boolean")
    return rows.groupBy(ident).agg(F.max("template").alias("template"), F.max("filler").alias("filler"), F.max("notice_share").alias("notice_share"), F.max("residue").alias("residue"))
