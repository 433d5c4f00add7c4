import random

import pytest

from viewlake.llm import residue as R

PLACES = ["the old mill", "a quiet harbour", "the north tower", "the glass roof", "our second bridge"]
ACTS = ["was photographed again", "needed another pass", "looked clean from all sides", "lost three of its views", "closed without a gap"]
WHEN = ["before the rain", "in the last hour of light", "on the first morning", "with a borrowed lens", "under thin clouds"]


def prose(rng, n=4):
    return " ".join(f"{rng.choice(PLACES).capitalize()} {rng.choice(ACTS)} {rng.choice(WHEN)}, and we kept {rng.randint(2, 90)} frames." for _ in range(n))


RESIDUE = [
    "Home | Maps | Help\nHarbour gate\nThe page you requested could not be found. Please try again later.",
    "Something went wrong on our side. An unexpected error occurred.\nReference 4f2a",
    "Please enable JavaScript to view this page.",
    "PLEASE TURN ON JAVASCRIPT IN YOUR BROWSER SETTINGS.",
    "Die angeforderte Seite wurde nicht gefunden.",
    "お探しのページは見つかりませんでした。",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.",
    "Dies ist ein Blindtext. Blindtext Blindtext Blindtext.",
    "Dear {{first_name}},\nthe set is ready.",
    "Date: [ enter date ]",
    "Place: {​% site​_name %}",
    "Remarks: ____ weather - to be filled in ____",
    "Contact: &lt;type your name&gt;",
]


def sound(rng):
    return [
        prose(rng), prose(rng, 12),
        prose(rng) + " In the header, write {{ folder }} and the exporter fills in the value.",
        prose(rng) + "\nfor f in ${FRAMES}/*.png; do check \"$f\"; done",
        prose(rng) + " A reader asked why the viewer said 'please enable JavaScript to view this page'. The kiosk had it blocked.",
        prose(rng) + " The draft still had 'Lorem ipsum dolor sit amet, consectetur adipiscing elit' under the photo; the printed one carries our own words.",
        prose(rng) + " Use {} for an empty map and [] for no flags, see [1] and <note 3>.",
        prose(rng) + "\n> 404 Not Found\nThat was the reply on the first try. " + prose(rng),
        "", " \n", None, "旧い窯を朗れた朝に撮影した。",
    ]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(8)
    filler = [(10_000 + i, prose(rng, rng.randint(2, 9)), "x") for i in range(400)]
    good = [(i, t, "x") for i, t in enumerate(sound(rng))]
    bad = [(1000 + i, t, "x") for i, t in enumerate(RESIDUE)] + [(1100, prose(rng, 900) + "\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit.\n\n" + prose(rng, 900), "x")]
    df = spark.createDataFrame(filler + good + bad + bad[:2], "doc_id bigint, text string, segments string").repartition(3)
    rows = {r["doc_id"]: r for r in R.find_residue(df, "doc_id", "text").collect()}
    assert len(rows) == len(filler) + len(good) + len(bad)
    return rows


@pytest.mark.parametrize("i", range(len(RESIDUE)))
def test_residue_is_found(found, i):
    assert found[1000 + i]["residue"], RESIDUE[i]


def test_filler_in_the_middle_of_a_long_text(found):
    assert found[1100]["filler"]


def test_sound_texts_stay(found):
    assert [i for i, r in found.items() if r["residue"] and not 1000 <= i <= 1100] == []


SPEAKS = [
    'Use the {{name}} tag in your letter to greet the reader.',
    'A tool looks through all reports for {mean_blur} and stops.',
    'Anyone who opens the form sees {{city}} there until the server answers, as described in chapter two.',
    'Our style sheet says that [[author]] must stand alone on a line.',
    'The converter turned every ${price} into a number.',
    'What does %USERNAME% do? It expands to the account that is logged on.',
    'Between the braces of {{ total }} you may add a filter, like {{ total|round }}.',
    'I forgot to quote ${HOME} in the script, so the shell expanded it.',
    'The linter complains about {{ item }} because no loop defines it.',
    'An old letter still had <<street>> in it; the printer caught it.',
    'Type {{signature}} and press enter to see the preview.',
    "The keyword @@date@@ expands to today's date.",
    'Der Ausdruck {{betrag}} wird beim Versand durch die Summe ausgetauscht.',
    'Mit ${name} spricht der Serienbrief den Empfänger an.',
    'Die Variable %ort% enthält den Namen der Stadt.',
    'Wer [[datum]] eintippt, bekommt das heutige Datum.',
    'La balise {{prenom}} sera remplacée par le prénom du client.',
    'On écrit ${total} là où la somme doit apparaître.',
    'La etiqueta {{nombre}} se cambia por el nombre del cliente.',
    'Escriba ${fecha} donde deba aparecer la fecha.',
    '{{氏名}}というタグは送信時に宛名に置き換わります。',
    '変数${合計}には金額が入ります。',
    'echo "Hello ${USER}" >> greeting.txt',
    'curl -X GET https://api.example.org/v1/${user_id}/posts',
    'const greeting = `Hi ${name}`;',
    "sed -i 's/%VERSION%/1.2/' setup.cfg",
    "logger.info('started %(name)s with ${args}')",
    'Our newsletter tool knows {{salutation}} and {{signature}}, nothing else.',
    'Please leave ${amount} untouched when you translate the sentence.',
    'A colleague deleted [[footer]] from the layout, so no page had one.',
    'The regular expression finds %MONTH% even inside of words.',
    'With {{ unsubscribe }} every mail gets its own link.',
    'Does anybody know why {{ price }} comes out empty?',
    'In chapter four we learn how <<chapter>> is resolved.',
    'The student used ${x} instead of $x and got an error.',
    'Der Editor färbt {{variable}} rot, damit man sie findet.',
    'Statt %DATUM% erschien im Brief nur eine Null.',
    "L'outil ignore [[image]] quand aucun fichier n'est joint.",
    'Si falta el dato, {{telefono}} queda vacío en la carta.',
    '本文に{{日付}}と書いておくと自動で変換されます。',
    'mv ${OLD} ${NEW} && ls -l',
    'return `${first} ${last}`.trim();',
    '2025-02-03 ERROR could not resolve ${db.password}',
]
OPEN = [
    'Dear {{first_name}}, please replace your password today.',
    'We enclose the manual for {{product}} with this letter.',
    'Hello {{user}}, your guide meets you at {{time}}.',
    'Please take notice that the office on {{street}} is closed.',
    'Thank you for staying with us from [check-in date] to [check-out date].',
    'The bus to ${destination} leaves at ${hour} from platform 4.',
    'Yours sincerely, [insert name]',
    'Invoice no. {{ invoice_number }}',
    'Our next open day is on <<date>>, and everybody is welcome.',
    'Last night %TEAM_NAME% beat the visitors by three goals.',
    'Patient: [PATIENT NAME], born on [DATE OF BIRTH]',
    'It was a bright morning when we reached {{place}} and set up the tent.',
    'Congratulations, {{winner}}! You have won {{prize}}.',
    'Opening hours: {{hours}}',
    'Sehr geehrte Frau {{nachname}}, Ihre Bestellung ist unterwegs.',
    'Die Führung beginnt am [Datum einfügen] um zehn Uhr.',
    'Rechnungsnummer: ${nummer}',
    'Wir bestätigen Ihren Termin am {{tag}}.',
    'Cher {{prenom}}, votre commande est arrivée.',
    'La réunion aura lieu le [[date]] à la mairie.',
    'Estimado {{cliente}}, su pedido ha salido.',
    'Nos vemos el ${dia} en la plaza.',
    '{{氏名}}様、ご予約ありがとうございます。',
    '開催日:[ここに日付]',
    'Dear [Recipient Name], I am writing to apply for the post of [Job Title].',
    'Our hotel lies only {{minutes}} minutes from the beach of {{town}}.',
    'The winner of the draw was {{name}} from {{city}}.',
    'Amount due: ${amount}',
    'See you on {{weekday}} at the usual place!',
    'This certificate is awarded to [Full Name] for attending [Course].',
    'Dr. %SURNAME% is away until %DATE%.',
    'On our way home we stopped at <<restaurant>> for dinner.',
    'Das Konzert von {{band}} beginnt um {{uhrzeit}}.',
    'Lieferadresse: [Straße eintragen]',
    'Unser Büro in ${stadt} bleibt heute geschlossen.',
    'Nous avons bien reçu votre lettre du {{date}}.',
    'Madame {{nom}}, nous vous remercions de votre visite.',
    'La tienda de {{calle}} abre a las {{hora}}.',
    'Gracias por comprar en {{tienda}}.',
    '{{会社名}}の{{担当者}}です。',
]
# not looked at while the seeds were written
UNSEEN_SPEAKS = [
    'Our typesetter reserves ${caption} for pictures.',
    'To greet somebody by name, start the letter with {{salutation}}.',
    'The spelling checker stumbles over [[company]] every time.',
    'Two files contain %YEAR%, the others have a fixed number.',
    'I wonder whether {{ amount }} also works in the subject line.',
    'The new release no longer accepts <<logo>>.',
    'Im Quelltext steht ${preis} an drei Stellen.',
    'Das Skript sucht nach [[kunde]] und gibt die Zeile aus.',
    "Dans la version actuelle, {{ville}} n'est plus accepté.",
    'El programa busca %CIUDAD% en cada línea.',
    'この設定では{{金額}}が三回使われています。',
    'tar -czf ${ARCHIVE} ${DIR}',
    "assert render('{{ x }}', x=1) == '1'",
    'val total = map.getOrElse(${key}, 0)',
]
UNSEEN_OPEN = [
    'Hi {{nickname}}, how was your holiday?',
    'The next bus from ${stop} is due in ${minutes} minutes.',
    'Guests: [number of guests]',
    'We were glad to hear that {{son}} has found work in {{town}}.',
    'Your account number is {{account}}.',
    'Last year %CLUB% had about 40 members.',
    'The old bridge near [[village]] was repaired in spring.',
    'Meine Großmutter kam aus {{ort}} und war Lehrerin.',
    'Ihre Kundennummer lautet ${kundennummer}.',
    'Notre équipe de [[ville]] a gagné le match.',
    'Su número de cliente es {{numero}}.',
    'Ayer visitamos el museo de ${ciudad}.',
    '会場は{{場所}}です。',
    'Prepared for: <<client name>>',
]


@pytest.mark.parametrize("line", ["{{name}}", "Total: ${stats.views}", "<% place %>", "[[ ort ]]", "Hello @@user@@,", "%CAMERA_MODEL%", "*** enter total ***", "site: __area__", "Lugar: «dirección»", "Ort: {Adresse eintragen}", "has {{ total frames"])
def test_marks_are_proposed(line):
    assert R.marked(R.clean(line))


@pytest.mark.parametrize("line", ["see [1] and [2]", "the set {A, B, C}", "a < b and c > d", "50 % of 100 %", "x = {'a': 1}", "[text](http://x)", "he said '{{x}} is empty now'", "il dit « la page est vide » et part", "snake_case_name", "2 * 3 * 4"])
def test_no_marks(line):
    assert not R.marked(R.clean(line))


@pytest.fixture(scope="module")
def told(spark):
    """Whether each sentence has an open mark, by models fitted on the documents of a small test table, which has none of the sentences."""
    texts = R.parsed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text").cache()
    models = R.fit(texts)
    texts.unpersist()
    return lambda line: bool((R._marked(["\n".join(R.marked(R.clean(line)))]).scores(models.marks) <= R.MARK_RATIO).any())


def test_open_marks_and_marks_spoken_about(told):
    found = [told(x) for x in OPEN]
    wrong = [told(x) for x in SPEAKS]
    assert sum(found) >= 0.9 * len(OPEN)
    assert sum(found) >= 0.9 * (sum(found) + sum(wrong))


def test_unseen_wording(told):
    """Open marks are found; of sentences about marks in wording far from the seeds, half are told apart."""
    assert sum(told(x) for x in UNSEEN_OPEN) >= 0.9 * len(UNSEEN_OPEN)
    assert sum(not told(x) for x in UNSEEN_SPEAKS) >= 0.5 * len(UNSEEN_SPEAKS)


def test_clean():
    assert R.clean("a​b c\r\nd") == "ab c\nd"
    assert R.clean("<p>Rеmarks</p>").strip() == "Remarks"
    assert R.clean("fÃ¼r") == "für"


def test_no_texts(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert R.find_residue(df, "doc_id", "text").count() == 0


def test_filler_that_shares_nothing_with_the_seeds(spark):
    rng = random.Random(3)
    good = [prose(rng, 4) for _ in range(60)] + [prose(rng) + " The sheet said 'qwzu qwzu qwzu qwzu qwzu qwzu qwzu qwzu qwzu qwzu' in its last row, which we left.", "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0.", "=" * 80 + "\n" + prose(rng), "It was very, very, very, very cold at the gate before dawn."]
    bad = ["Qwzu " + "qwzu " * 20 + "qwzu.", prose(rng) + "\n\n" + "words " * 15 + "...\n\n" + prose(rng), "Xxxx xxxx xxxx xxxx xxxx xxxx xxxx xxxx xxxx."]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    found = {r["doc_id"] for r in R.find_residue(df, "doc_id", "text").where("filler").collect()}
    assert found == set(range(len(good), len(good) + len(bad)))


def test_short_filler_adds_up(spark):
    rng = random.Random(4)
    rows = [prose(rng, 4) for _ in range(60)] + ["ダミーテキストです。 ダミーテキストです。 ダミーテキストです。", "XXXX XXXX XXXX XXXX XXXX\n" + prose(rng)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in R.find_residue(df, "doc_id", "text").where("filler").collect()} == {60, 61}
