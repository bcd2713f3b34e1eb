"""Labelled sentences for the personal-data model, written from general knowledge (``phrases`` says how they are kept
apart from the test tables).

Slots with a label: {P} a person ({p}: in small letters), {I} an identity number, {T} a telephone number, {A} a street
address, {E} an e-mail address. Everything else, {X...} slots included, is no personal data.
"""

from __future__ import annotations

import random

from . import phrases

# Sentences that carry personal data, and look-alikes, by language.
SENTENCES = {
    "en": [
        "The booking was made by {P}, passport number {I}.", "I'm {P}, membership card {I}.", "Best wishes, {P}", "Yours sincerely, {P}.", "Thanks!\n{P}", "Cheers, {P}", "Kind regards\n{P}", "Sincerely, {P}", "Thank you - {P}", "My colleague {P} wants a window seat.", "My uncle {P} was born near {N}.", "Our tenant, {P}, pays on time.", "it's {p} speaking, is the parcel there?", "hi, {p} here. any news?", "i'm {p} from the chess club", "{P} speaking, phone {T}.",
        "Deliver it to {P}, {A}, {E}.", "Ask {P} ({E}) for the code.", "We moved to {A} last month.", "The parcel should go to {A}.", "They live in {A}, on the second floor.", "National insurance number: {I}", "Driving licence {I} was issued in {d}.", "Social security no. {I}", "Tax ID {I}, see form.", "The patient's record, {I}, is locked.", "Ring {T} after six.", "Phone: {T}", "Mobile {T}", "Fax {T}, mail {E}", "Text me at {T} or write to {E}.", "Forward all bills to {E}.", "Mail: {E}", "The complaint was raised by {P} yesterday.", "This key belongs to {P}.", "{t}{P} teaches {F} on Mondays.", "Doctor on duty: {t}{P}, {T}", "Guest of honour was {t}{P}.", "The applicant {P} (ID {I}) was heard.", "Owner: {P}, {A}", "Tickets are sold by {P}, {A}, every evening.", "{P} and {P} won the doubles.", "according to {P}, the road is open", "{t}{P} can be reached on {T}.", "In an emergency call {t}{P}: {T}.", "The bride, {P}, wore blue.", "Photo by {P}", "Author: {P}",
        "The {N} Cup was won by team {C}.", "Take {N} Street and turn left.", "{N} Avenue is closed from 9 to 12.", "The {N} Road bakery sells {d} loaves.", "Track shipment {X8} online.", "Case {X8} of {Xyears} was closed.", "Book ISBN {Xisbn} is sold out.", "Serial number {X8}-{X5} is on the box.", "Gate {X2} opens at 08:15-17:45.", "Seats {Xroom} and {Xroom} are taken.", "Software {Xver} was released on {date}.", "Invoice no. {X8}: {X3} euros.", "The order {X5}-{X8} was lost.", "See @{h}_news and @{h}.", "chapter {X2}, page {X3}", "Part {C} costs {X5}.", "Bank holidays {Xyears}", "South {N} beat North {N}.", "The Old {N} Mill and the New {N} Mill are twins.", "Modern {F} Today", "Monday Tuesday Wednesday",
    ],
    "fr": [
        "La réservation est au nom de {P}, carte nationale {I}.", "Moi c'est {P}, adhérent {I}.", "Bien à vous, {P}", "Salutations, {P}.", "Merci d'avance\n{P}", "Sincères salutations\n{P}", "Amicalement, {P}", "Mon collègue {P} veut une place à la fenêtre.", "Ma tante {P} est née près de {N}.", "Notre locataire, {P}, paie à temps.", "bonsoir, {p} à l'appareil, le colis est là ?", "moi c'est {p} du club d'échecs", "{P} à l'appareil, portable {T}.",
        "À livrer chez {P}, {A}, {E}.", "Demandez le code à {P} ({E}).", "Nous avons déménagé au {A} le mois dernier.", "Le colis doit partir pour {A}.", "Elle loge au {A}, deuxième étage.", "Numéro de sécurité sociale : {I}", "Permis de conduire {I} délivré en {d}.", "Numéro fiscal {I}, voir formulaire.", "Le dossier du patient, {I}, est fermé.", "Appelez le {T} après six heures.", "Téléphone : {T}", "Portable {T}", "Fax {T}, courriel {E}", "Un message au {T} ou à {E} suffit.", "Faites suivre les factures à {E}.", "Courriel : {E}", "La plainte vient de {P} hier soir.", "Cette clé appartient à {P}.", "{t}{P} enseigne la {F} le lundi.", "Médecin de garde : {t}{P}, {T}", "L'invitée d'honneur fut {t}{P}.", "Le candidat {P} (numéro {I}) fut entendu.", "Propriétaire : {P}, {A}", "Les billets sont vendus par {P}, {A}.", "{P} et {P} ont gagné le double.", "d'après {P}, la route est libre", "On peut joindre {t}{P} au {T}.", "En urgence appelez {t}{P} : {T}.", "Photo de {P}", "Auteur : {P}",
        "La coupe {N} fut gagnée par l'équipe {C}.", "Prenez la rue {N} puis à gauche.", "L'avenue {N} est coupée de 9 à 12.", "Suivez l'envoi {X8} en ligne.", "L'affaire {X8} de {Xyears} est close.", "Le livre ISBN {Xisbn} est épuisé.", "Le numéro de série {X8}-{X5} est sur la boîte.", "La porte {X2} ouvre de 08:15-17:45.", "Les sièges {Xroom} et {Xroom} sont pris.", "Le logiciel {Xver} est sorti le {date}.", "Facture no {X8} : {X3} euros.", "Voir @{h}_infos et @{h}.", "chapitre {X2}, page {X3}", "La pièce {C} coûte {X5}.", "Les deux moulins de {N} sont jumeaux.",
    ],
    "de": [
        "Die Buchung läuft auf {P}, Personalausweis {I}.", "Mein Name: {P}, Mitglied {I}.", "Viele Grüße, {P}", "Herzlich, {P}.", "Danke!\n{P}", "Hochachtungsvoll\n{P}", "Liebe Grüße\n{P}", "Mein Kollege {P} wünscht einen Fensterplatz.", "Meine Tante {P} wurde bei {N} geboren.", "Unsere Mieterin, {P}, zahlt pünktlich.", "guten abend, {p} am apparat, ist das paket da?", "ich heisse {p} und spiele schach", "{P} am Apparat, Handy {T}.",
        "Zu liefern an {P}, {A}, {E}.", "Fragen Sie {P} ({E}) nach dem Code.", "Wir sind im Mai in die {A} gezogen.", "Das Paket soll zur {A}.", "Sie lebt in der {A}, zweiter Stock.", "Sozialversicherungsnummer: {I}", "Führerschein {I} wurde {d} ausgestellt.", "Steuernummer {I}, siehe Formular.", "Die Akte der Patientin, {I}, ist gesperrt.", "Rufen Sie {T} nach sechs an.", "Telefon: {T}", "Handy {T}", "Fax {T}, Mail {E}", "Eine Nachricht an {T} oder {E} genügt.", "Alle Rechnungen bitte an {E}.", "E-Mail: {E}", "Die Beschwerde stammt von {P} aus {N}.", "Dieser Schlüssel gehört {P}.", "{t}{P} lehrt montags {F}.", "Dienst hat {t}{P}, {T}", "Ehrengast war {t}{P}.", "Der Bewerber {P} (Nummer {I}) wurde gehört.", "Eigentümer: {P}, {A}", "Karten verkauft {P}, {A}.", "{P} und {P} siegten im Doppel.", "laut {P} ist die Straße frei", "Man erreicht {t}{P} unter {T}.", "Im Notfall {t}{P} anrufen: {T}.", "Foto: {P}", "Autorin: {P}",
        "Den {N}-Pokal holte Mannschaft {C}.", "Der {G}-{N}-Orden ist {d} wert.", "Der {G}-{N}-Turm steht seit {d}.", "Man traf sich im {G}-{N}-Park.", "Man geht die {N}straße hinab.", "Nehmen Sie die {N}straße und dann links.", "Die {N}allee ist von 9 bis 12 gesperrt.", "Sendung {X8} online verfolgen.", "Fall {X8} aus {Xyears} ist erledigt.", "Das Buch ISBN {Xisbn} ist vergriffen.", "Die Seriennummer {X8}-{X5} steht am Karton.", "Tor {X2} öffnet 08:15-17:45.", "Die Sitze {Xroom} und {Xroom} sind belegt.", "Software {Xver} erschien am {date}.", "Rechnung Nr. {X8}: {X3} Euro.", "Siehe @{h}_aktuell und @{h}.", "Kapitel {X2}, Blatt {X3}", "Teil {C} kostet {X5}.", "Alte Mühle und Neue Mühle in {N} sind gleich.", "Das Kleine Haus am See", "Guter Wein aus {N}",
    ],
    "es": [
        "La reserva está a nombre de {P}, documento {I}.", "Mi nombre: {P}, socio {I}.", "Saludos cordiales, {P}", "Atentamente, {P}.", "Gracias\n{P}", "Un abrazo\n{P}", "Cordialmente, {P}", "Mi colega {P} quiere un asiento de ventana.", "Mi tía {P} nació cerca de {N}.", "Nuestra inquilina, {P}, paga a tiempo.", "buenas, habla {p}, ¿llegó el paquete?", "mi nombre es {p} y juego al ajedrez", "Habla {P}, móvil {T}.",
        "Entregar a {P}, {A}, {E}.", "Pidan el código a {P} ({E}).", "Nos mudamos a {A} el mes pasado.", "El paquete debe ir a {A}.", "Reside en {A}, segundo piso.", "Número de seguridad social: {I}", "Permiso de conducir {I} expedido en {d}.", "Número fiscal {I}, véase el formulario.", "El expediente de la paciente, {I}, está cerrado.", "Llame al {T} después de las seis.", "Teléfono: {T}", "Móvil {T}", "Fax {T}, correo {E}", "Basta un mensaje al {T} o a {E}.", "Envíen todas las facturas a {E}.", "Correo: {E}", "La queja es de {P} de ayer.", "Esta llave pertenece a {P}.", "{t}{P} enseña {F} los lunes.", "Médico de guardia: {t}{P}, {T}", "La invitada de honor fue {t}{P}.", "El candidato {P} (número {I}) fue oído.", "Dueño: {P}, {A}", "Las entradas las vende {P}, {A}.", "{P} y {P} ganaron el doble.", "según {P}, el camino está libre", "Se puede llamar a {t}{P} al {T}.", "En emergencias avise a {t}{P}: {T}.", "Foto de {P}", "Autora: {P}",
        "La copa {N} la ganó el equipo {C}.", "Tome la calle {N} y luego a la izquierda.", "La avenida {N} se corta de 9 a 12.", "Siga el envío {X8} en línea.", "El caso {X8} de {Xyears} se cerró.", "El libro ISBN {Xisbn} se agotó.", "El número de serie {X8}-{X5} está en la caja.", "La puerta {X2} abre de 08:15-17:45.", "Los asientos {Xroom} y {Xroom} están ocupados.", "El programa {Xver} salió el {date}.", "Factura n.º {X8}: {X3} euros.", "Vean @{h}_hoy y @{h}.", "capítulo {X2}, página {X3}", "La pieza {C} cuesta {X5}.", "El Molino Viejo y el Molino Nuevo de {N} son iguales.",
    ],
    "ar": [
        "الحجز باسم {P}، بطاقة وطنية {I}.", "الاسم: {P}، العضوية {I}.", "تحياتي، {P}", "مع خالص الشكر\n{P}", "وتفضلوا بقبول الاحترام، {P}.", "شكرا\n{P}", "زميلي {P} يريد مقعدا قرب النافذة.", "زميلتي {P} تريد مقعدا قرب النافذة.", "عمي {P} ولد قرب {N}.", "خالتي {P} ولدت قرب {N}.", "المستأجر، {P}، يدفع في موعده.", "يتحدث {P}، جوال {T}.", "هنا {P}، هل وصل الطرد؟", "يسلم إلى {P}، {A}، {E}.", "اطلبوا الرمز من {P} ({E}).", "انتقلنا إلى {A} في الشهر الماضي.", "يرسل الطرد إلى {A}.", "تقيم في {A} بالطابق الثاني.", "رقم الضمان الاجتماعي: {I}", "رخصة القيادة {I} صدرت عام {d}.", "الرقم الضريبي {I}، انظر الاستمارة.", "ملف المريضة، {I}، مغلق.",
        "كلموني على {T} بعد السادسة.", "الهاتف: {T}", "الجوال {T}", "فاكس {T}، بريد {E}", "تكفي رسالة إلى {T} أو {E}.", "حولوا كل الفواتير إلى {E}.", "البريد: {E}", "قدم الشكوى {P} أمس.", "هذا المفتاح يخص {P}.", "يدرس {t}{P} مادة {F} كل اثنين.", "الطبيب المناوب: {t}{P}، {T}", "كان ضيف الشرف {t}{P}.", "سمعت اللجنة أقوال {P} (رقم {I}).", "المالك: {P}، {A}", "يبيع التذاكر {P}، {A}.", "فاز {P} و {P} بالزوجي.", "قال {P} إن الطريق سالك", "يمكن الاتصال بـ {t}{P} على {T}.", "عند الطوارئ نادوا {t}{P}: {T}.", "تصوير {P}", "الكاتبة: {P}", "يقيم {t}{P} في {A}.",
        "فاز الفريق {C} بكأس {N}.", "خذ شارع {N} ثم يسارا.", "يغلق طريق {N} من 9 إلى 12.", "تتبع الشحنة {X8} على الشبكة.", "أغلقت القضية {X8} لعام {Xyears}.", "نفد الكتاب ISBN {Xisbn}.", "الرقم التسلسلي {X8}-{X5} على العلبة.", "تفتح البوابة {X2} من 08:15-17:45.", "المقعدان {Xroom} و {Xroom} محجوزان.", "صدر البرنامج {Xver} يوم {date}.", "فاتورة رقم {X8}: {X3} يورو.", "انظروا @{h}_news و @{h}.", "فصل {X2}، صفحة {X3}", "القطعة {C} ثمنها {X5}.",
    ],
}
# Common given and family names (training texts only; candidates do not depend on them).
GIVEN = {
    "en": ["William", "Jennifer", "Michael", "Patricia", "Robert", "Linda", "Thomas", "Susan", "Kevin", "Karen", "Brian", "Nancy", "George", "Betty", "Ronald", "Helen", "Priya", "Omar", "Wojciech", "Ifeoma", "Yuki", "Dmitri", "Chen", "Aisha"],
    "fr": ["François", "Nathalie", "Laurent", "Sylvie", "Olivier", "Valérie", "Thierry", "Céline", "Guillaume", "Margaux", "Benoît", "Amélie", "Fatou", "Mehdi"],
    "de": ["Wolfgang", "Monika", "Dieter", "Renate", "Stefan", "Ursula", "Matthias", "Birgit", "Jörg", "Kerstin", "Uwe", "Annika", "Emre", "Zeynep"],
    "es": ["Alejandro", "Rosario", "Manuel", "Dolores", "Francisco", "Consuelo", "Rafael", "Beatriz", "Andrés", "Ximena", "Joaquín", "Noelia", "Iker", "Ainhoa"],
    "ar": ["خالد", "يوسف", "إبراهيم", "عمر", "حسن", "حسين", "علي", "مصطفى", "ياسر", "نادر", "وليد", "رامي", "سارة", "مريم", "خديجة", "عائشة", "نور", "رنا", "دينا", "سعاد", "أمل", "هدى", "منى", "سهام"],
}
FAMILY = {
    "en": ["Carter", "O'Brien", "Whitfield", "McAllister", "Nguyen", "Patel", "Okafor", "Kowalski", "Lawson", "Haddad", "Ivanov", "Tanaka", "Van Dyke", "Reed"],
    "fr": ["Dubois", "Lefèvre", "de La Tour", "Morel", "N'Diaye", "Girard", "Benali", "Chevalier"], "de": ["Schneider", "von Berg", "Krüger", "Zimmermann", "Yıldız", "Vogt", "Maier", "Großmann"],
    "es": ["García López", "Fernández", "de la Cruz", "Ibáñez", "Etxeberria", "Romero", "Núñez"], "ar": ["المصري", "حداد", "الخطيب", "نجار", "الشامي", "البغدادي", "العلي", "قاسم", "السعدي", "الحلبي"],
}
TITLES = {
    "en": ["Dr. ", "Dr ", "Prof. ", "Mr ", "Ms ", "Mrs ", "Professor ", "Captain "], "fr": ["M. ", "Mme ", "Dr ", "Pr ", "Prof. ", "Monsieur ", "Madame ", "Maître "], "de": ["Herr ", "Frau ", "Dr. ", "Prof. ", "Herrn ", "Pfarrer "],
    "es": ["Sr. ", "Sra. ", "Dr. ", "Dra. ", "Prof. ", "Don ", "Doña ", "Ing. "], "ar": ["السيد ", "السيدة ", "الدكتور ", "الدكتورة ", "الأستاذ ", "الأستاذة ", "المهندس "],
}
# Words for bodies and for buildings, prizes and places that bear names.
BODIES = {
    "en": ["University", "College", "School", "Institute", "Hospital", "Bank", "Hotel", "Club", "Company", "Group", "Society", "Council", "Office", "Team", "Choir", "Campus", "Programme", "Festival", "Department", "Survey"],
    "fr": ["Université", "École", "Institut", "Hôpital", "Banque", "Hôtel", "Club", "Société", "Groupe", "Mairie", "Bureau", "Chorale", "Campus", "Festival", "Programme"], "de": ["Universität", "Hochschule", "Schule", "Institut", "Klinik", "Bank", "Hotel", "Verein", "Gruppe", "Rathaus", "Amt", "Chor", "Campus", "Festival", "Programm"],
    "es": ["Universidad", "Colegio", "Escuela", "Instituto", "Hospital", "Banco", "Hotel", "Club", "Grupo", "Concejo", "Oficina", "Coro", "Campus", "Festival", "Programa"], "ar": ["جامعة", "كلية", "مدرسة", "معهد", "مستشفى", "بنك", "فندق", "نادي", "شركة", "مجموعة", "بلدية", "مكتب", "فرقة", "برنامج", "مختبر"],
}
BUILDINGS = {
    "en": ["Prize", "Cup", "Medal", "Award", "Hall", "Tower", "Bridge", "Park", "Square", "Library", "Museum", "Building", "House", "Centre", "Room", "Stadium", "Theatre", "Station", "Street", "Road", "Avenue"],
    "fr": ["prix", "trophée", "salle", "tour", "pont", "parc", "place", "bibliothèque", "musée", "bâtiment", "maison", "centre", "stade", "théâtre", "gare", "rue", "avenue"], "de": ["Preis", "Pokal", "Saal", "Turm", "Brücke", "Park", "Platz", "Bibliothek", "Museum", "Gebäude", "Haus", "Zentrum", "Stadion", "Theater", "Bahnhof", "Straße", "Allee"],
    "es": ["premio", "trofeo", "sala", "torre", "puente", "parque", "plaza", "biblioteca", "museo", "edificio", "casa", "centro", "estadio", "teatro", "estación", "calle", "avenida"], "ar": ["جائزة", "كأس", "قاعة", "برج", "جسر", "حديقة", "ميدان", "ساحة", "مكتبة", "متحف", "مبنى", "بيت", "مركز", "ملعب", "مسرح", "محطة", "شارع", "طريق"],
}
#: Templates of named bodies, buildings and places; the word stands where the language puts it.
SHELLS = {
    "en": ["{N} {O} opened in {d}.", "The {N} {O} meets today.", "About {N}", "At {N} {O}", "The {G} {N} {B} is near.", "Behind the {G} {N} {B}.", "{G} {N} {B} closes early.", "The {N} {B}", "{O} of {F}", "They won the {G} {N} {B}.", "We met at {G} {N} {B}, near the {N} {O}.", "© {d} {N} {O}", "News of the {N} {O}", "{C} {N} {F}"],
    "fr": ["{O} {N} ouvre en {d}.", "{N} {O}", "Sur {N}", "Le {B} {G} {N} est proche.", "Derrière le {B} {G} {N}.", "On se voit au {B} {G} {N} ce soir.", "Le {B} {G} {N} revient à l'équipe {C}.", "La {B} {N}", "© {d} {N} {O}", "La {B} {G} {N} ferme tôt.", "Carte de {N}", "Plan de {N}", "Photos de {N}", "L'{O} {N} paie."], "de": ["{O} {N} öffnet {d}.", "{N} {O}", "Zu {N}", "Der {G}-{N}-{B} ist nah.", "Hinter dem {G} {N} {B}.", "Wir sehen uns am {G}-{N}-{B}.", "Den {G}-{N}-{B} bekam Mannschaft {C}.", "Das {B} {N}", "© {d} {N} {O}", "Das {B} {G} {N} schließt früh.", "Karte von {N}", "Bilder von {N}", "Herz der {N}"],
    "es": ["{O} {N} abre en {d}.", "{N} {O}", "De {N}", "El {B} {G} {N} está cerca.", "Detrás del {B} {G} {N}.", "Nos vemos en el {B} {G} {N} mañana.", "El {B} {G} {N} fue para el equipo {C}.", "La {B} {N}", "© {d} {N} {O}", "La {B} {G} {N} cierra pronto.", "Mapa de {N}", "Fotos de {N}", "Historia de {N}", "Cartas de {N} a {O}"], "ar": ["فتحت {O} {N} عام {d}.", "{O} {N}", "قرب {B} {G} {N}.", "خلف {B} {N}", "نلتقي عند {B} {G} {N} مساء.", "ذهبت {B} {G} {N} إلى الفريق {C}.", "{B} {G} {N} مغلق.", "تجتمع {O} {N} اليوم.", "© {d} {O} {N}", "دخلنا {B} {G} {N} مساء."],
}
# Names of months.
MONTHS = {
    "en": ["January", "march", "May", "July", "September", "november", "December"], "fr": ["janvier", "mars", "mai", "juillet", "septembre", "novembre"], "de": ["Januar", "März", "Mai", "Juli", "September", "November"],
    "es": ["enero", "marzo", "mayo", "julio", "septiembre", "noviembre"], "ar": ["يناير", "مارس", "مايو", "يوليو", "سبتمبر", "نوفمبر"],
}
DATES = {
    "en": ["until {d} {m} {y}", "on {m} {d}, {y}", "since {m} {d} {y}"], "fr": ["jusqu'au {d} {m} {y}", "depuis le {d} {m} {y}"], "de": ["bis zum {d}. {m} {y}", "seit dem {d}. {m} {y}"], "es": ["hasta el {d} de {m} de {y}", "desde el {d} {m} {y}"], "ar": ["حتى {d} {m} {y}", "منذ {d} {m} {y}"],
}
# Types of streets before, after or at the end of the name.
STREETS = {
    "en": ["Street", "St", "St.", "Road", "Rd", "Rd.", "Lane", "Avenue", "Ave", "Drive", "Court", "Way", "Close", "Terrace", "Crescent", "Boulevard", "Hill", "Square", "Place", "Row", "Grove", "Gardens"],
    "fr": ["rue", "avenue", "boulevard", "place", "allée", "chemin", "impasse", "quai", "route", "square", "cours", "passage"], "de": ["straße", "str.", "weg", "gasse", "allee", "platz", "ring", "ufer", "damm", "steig"],
    "es": ["Calle", "C/", "Avenida", "Avda.", "Plaza", "Paseo", "Camino", "Ronda", "Travesía", "Carretera"], "ar": ["شارع", "طريق", "جادة", "حارة", "زقاق"],
}


def _phone(rnd: random.Random) -> str:
    """A number in one of the ways in which telephone numbers are written."""
    sep = rnd.choice([" ", " ", "-", ".", ""])
    group = lambda *n: sep.join("".join(str(rnd.randint(0, 9)) for _ in range(k)) for k in n)
    country = rnd.choice(["+", "+", "00"]) + str(rnd.randint(1, 999)) + (sep or rnd.choice(["", " "]))
    local = group(*rnd.choice([(3, 3, 4), (2, 2, 2, 2), (3, 4), (3, 3, 3), (4, 3, 3), (5, 6), (3, 5, 3), (2, 4, 4), (3, 2, 2), (4, 6), (3, 3, 2, 2)]))
    area = "0" + "".join(str(rnd.randint(1, 9)) for _ in range(rnd.randint(1, 4)))
    return rnd.choice([country + local, country + local, area + rnd.choice([" ", "/", "-", " / ", ""]) + local, f"({area}) {local}", country + f"({area.lstrip('0') or 9}) {local}", "0" + local, local if len(local.replace(sep, "")) >= 8 or sep else area + local])


def _identity(rnd: random.Random) -> str:
    """A number of a person's document or file: digits in groups with letters before or after."""
    n = lambda k: "".join(str(rnd.randint(0, 9)) for _ in range(k))
    a = lambda k: "".join(rnd.choice("ABCDEFGHJKLMNPQRSTXYZ") for _ in range(k))
    return rnd.choice([
        lambda: a(rnd.randint(1, 3)) + n(rnd.randint(6, 8)), lambda: n(rnd.randint(7, 9)) + a(1), lambda: a(rnd.randint(2, 4)) + rnd.choice(["-", " ", "/"]) + n(rnd.randint(6, 8)), lambda: a(2) + " " + " ".join(n(2) for _ in range(3)) + " " + a(1), lambda: a(1) + str(rnd.randint(1990, 2026)) + rnd.choice(["-", ""]) + n(rnd.randint(4, 6)),
        lambda: n(3) + "-" + n(2) + "-" + n(4), lambda: n(4) + "-" + n(4) + "-" + n(4) + rnd.choice(["", "-" + n(1), "-" + n(4)]), lambda: " ".join(n(4) for _ in range(rnd.randint(2, 4))), lambda: str(rnd.randint(1990, 2026)) + " " + n(4) + " " + n(3), lambda: n(rnd.randint(8, 12)), lambda: n(6) + "-" + n(rnd.randint(4, 5)), lambda: n(3) + " " + n(3) + " " + n(3), lambda: n(4) + " " + n(4) + " " + n(3), lambda: a(1) + n(7) + a(1), lambda: a(2) + n(2) + rnd.choice([" ", ""]) + " ".join(n(4) for _ in range(3)),
    ])()


def _digits(number: str, arabic: bool) -> str:
    return number.translate({48 + i: 0x660 + i for i in range(10)}) if arabic else number


def _surname(lang: str, rnd: random.Random) -> str:
    if rnd.random() < 0.2:
        return rnd.choice(FAMILY[lang])
    if lang == "ar":
        return rnd.choice(["ال", "ال", "ال", ""]) + _invented(lang, rnd, rnd.choice([2, 3])) + rnd.choice(["ي", "ي", "اني", ""])
    one = lambda: _invented(lang, rnd, rnd.choice([2, 2, 3]))
    s = one() + ("-" + one() if rnd.random() < 0.12 else "")
    return s.upper() if rnd.random() < 0.1 else s


def _given(lang: str, rnd: random.Random) -> str:
    """A given name, mostly one no list knows."""
    return _invented(lang, rnd, 2) if rnd.random() < 0.65 else rnd.choice(GIVEN[lang])


def _invented(lang: str, rnd: random.Random, syllables: int) -> str:
    """A name of random syllables."""
    if lang == "ar":
        return "".join(rnd.choice("بتجحدرزسشصطعفقكلمنهو") + rnd.choice(["", "ا", "ي", "و"]) for _ in range(syllables))
    out = "".join(rnd.choice("bcdfghjklmnprstvwz") + rnd.choice("aeiou") + rnd.choice(["", "", "n", "r", "l", "s", "th", "nd"]) for _ in range(syllables))
    return out.title()


def _person(lang: str, rnd: random.Random) -> str:
    given = _given(lang, rnd)
    if lang != "ar" and rnd.random() < 0.2:
        given = given[0] + "."
    return given + (f" {rnd.choice('ABCFHKLMR')}." if lang != "ar" and len(given) > 2 and rnd.random() < 0.15 else "") + " " + _surname(lang, rnd)


def _address(lang: str, rnd: random.Random) -> str:
    n, kind = str(rnd.randint(1, 399)), rnd.choice(STREETS[lang])
    s = phrases.fill("{N}", "ar" if lang == "ar" else "en", rnd)
    post = rnd.choice(["", "", f", {rnd.randint(10000, 99999)} {phrases.fill('{N}', 'en', rnd)}"])
    if lang == "en":
        return n + rnd.choice(["", "", "a", "b"]) + " " + rnd.choice(["", "", "Old ", "North ", "Upper "]) + s + " " + kind + rnd.choice(["", "", f", Flat {rnd.randint(1, 40)}", f", {s} 4QZ"])
    if lang == "fr":
        return n + rnd.choice([" ", ", ", " bis ", " ter, "]) + kind + rnd.choice([" ", " de ", " du ", " des "]) + s + post
    if lang == "de":
        return rnd.choice([s + kind, s + kind, f"{s}-{kind.title()}", f"{s}er {kind.title()}"]) + " " + n + rnd.choice(["", "", "a", "c"]) + post
    if lang == "es":
        return kind + rnd.choice([" ", " de ", " del "]) + s + rnd.choice([" ", ", ", ", n.º ", " núm. "]) + n + rnd.choice(["", "", ", 2.º A", ", bajo"])
    return rnd.choice([f"{kind} {s} {n}", f"{kind} {s}، مبنى {n}", f"{n} {kind} {s}", f"{kind} {s} رقم {n}"])


def _email(lang: str, rnd: random.Random) -> str:
    a, b = phrases.fill("{N}", "en", rnd).lower(), rnd.choice(GIVEN["en"]).lower()
    user = rnd.choice([f"{b}.{a}", f"{a}-{b}", f"{b}_{a}", f"{b[0]}{a}", f"{a}{rnd.randint(1, 99)}", f"{b}.{a}+shop"])
    host = rnd.choice(["", "post.", "web."]) + phrases.fill("{N}", "en", rnd).lower() + rnd.choice(["", "-club"]) + "." + rnd.choice(["com", "net", "co", "info", "org", "edu", "test", "example"])
    style = rnd.random()
    if style < 0.6:
        out = f"{user}@{host}"
        return out.upper() if rnd.random() < 0.1 else out
    at, dot = rnd.choice([(" (at) ", "."), ("[at]", "[dot]"), (" AT ", " DOT "), (" at ", " dot "), (" [at] ", "."), ("(at)", "(dot)")])
    head, _, tail = host.rpartition(".")
    return f"{user}{at}{head}{dot}{tail}"


# Words that bring a person into a sentence.
WITH = {"en": ["with", "for", "by", "to", "from", "and", "near", "like", "says", "but"], "fr": ["avec", "pour", "par", "chez", "et", "contre", "selon", "dit"], "de": ["mit", "für", "von", "bei", "und", "gegen", "nach", "sagt"], "es": ["con", "para", "por", "y", "contra", "según", "dice", "junto a"], "ar": ["مع", "عند", "قرب", "ضد", "قال", "زار", "شكر", "إلى"]}


def _named_sentence(lang: str, rnd: random.Random) -> str:
    """A template: a plain sentence about a person, or about a body of some name."""
    who = "{P}" if rnd.random() < 0.6 else rnd.choice(["{N}", "{G} {N} {B}" if lang == "en" else "{B} {G} {N}", "{O} {N}"])
    subject, *rest = (rnd.choice(p) for p in (phrases.PROSE if rnd.random() < 0.5 else phrases.MODAL)[lang])
    r = rnd.random()
    if lang != "ar" and r < 0.4:
        return " ".join([who, *rest]) + "."
    if r < 0.7:
        return " ".join([subject, *rest[:-1], rnd.choice(WITH[lang]), who, rest[-1]]) + "."
    return " ".join([subject, *rest, rnd.choice(WITH[lang]), who]) + rnd.choice([".", ".", ", " + rnd.choice(WITH[lang]) + " {N}."])


def labelled_text(rnd: random.Random, half: int | None = None) -> tuple[str, list[tuple[str, int]]]:
    """A text of a few sentences and its labelled (type, start) spans, 0-based; with ``half`` only from every other sentence."""
    text, spans = "", []
    lang = rnd.choice(list(SENTENCES))
    for _ in range(rnd.randint(1, 4)):
        r = rnd.random()
        if r < 0.25:
            prose = " ".join(phrases.main_line(lang, rnd) for _ in range(rnd.choice([1, 1, 2, 4])))
            text += prose.lower() if rnd.random() < 0.15 else prose
        elif r < 0.36:
            rest = rnd.choice(SHELLS[lang])
            for slot in ("N", "G", "O", "B"):
                while "{" + slot + "}" in rest:
                    rest = rest.replace("{" + slot + "}", {"N": lambda: _surname(lang, rnd).split("-")[0], "G": lambda: _given(lang, rnd), "O": lambda: rnd.choice(BODIES[lang]), "B": lambda: rnd.choice(BUILDINGS[lang])}[slot](), 1)  # noqa: B023
            text += phrases.fill(rest, lang, rnd)
        elif r < 0.42:  # dates in sentences
            text += phrases.sentence(lang, rnd)[:-1] + " " + rnd.choice(DATES[lang]).format(d=rnd.randint(1, 28), y=rnd.randint(2019, 2027), m=rnd.choice(MONTHS[lang])) + rnd.choice([".", " ", ""])
        elif r < 0.54:  # page furniture, headings and lists
            line = phrases.fill(rnd.choice(rnd.choice([phrases.FURNITURE, phrases.FURNITURE, phrases.TITLES, phrases.HEADINGS, phrases.ENTRIES, phrases.MENU])[lang]), lang, rnd)
            text += (line.upper() if rnd.random() < 0.12 else line) + rnd.choice(["\n", f" ({rnd.randint(1, 99)})\n", "\n\n"])
        else:
            rest = _named_sentence(lang, rnd) if rnd.random() < 0.25 else rnd.choice(SENTENCES[lang][half::2] if half is not None else SENTENCES[lang])
            while rest:
                before, brace, rest = rest.partition("{")
                text += before
                if not brace:
                    break
                slot, _, rest = rest.partition("}")
                kind = {"P": "name", "p": "name", "I": "id_number", "T": "phone", "A": "address", "E": "email"}.get(slot)
                if kind:
                    spans.append((kind, len(text)))
                arabic = lang == "ar" and rnd.random() < 0.35
                n = lambda k: str(rnd.randint(10 ** (k - 1), 10**k - 1))
                text += {
                    "P": lambda: _person(lang, rnd), "p": lambda: _person(lang, rnd).lower(), "I": lambda: _digits(_identity(rnd), arabic), "T": lambda: _digits(_phone(rnd), arabic), "A": lambda: _address(lang, rnd), "E": lambda: _email(lang, rnd),
                    "t": lambda: rnd.choice(["", *TITLES[lang]]), "G": lambda: rnd.choice(GIVEN[lang]), "O": lambda: rnd.choice(BODIES[lang]), "B": lambda: rnd.choice(BUILDINGS[lang]), "h": lambda: phrases.fill("{N}", "en", rnd).lower(), "Xisbn": lambda: f"{rnd.choice(['978', '979'])}-{n(1)}-{n(2)}-{n(6)}-{n(1)}", "X8": lambda: n(rnd.randint(6, 9)), "X5": lambda: n(5), "X3": lambda: n(3), "X2": lambda: n(2),
                    "Xyears": lambda: f"{rnd.randint(1980, 2010)}-{rnd.randint(2011, 2027)}", "Xroom": lambda: f"{n(2)}-{n(3)}", "Xver": lambda: f"{n(1)}.{n(2)}.{n(3)}",
                }.get(slot, lambda: phrases.fill("{" + slot + "}", lang, rnd))()  # noqa: B023
        text += rnd.choice([" ", " ", "\n", "! ", "!!! "]) if rnd.random() < 0.9 else " "
    return text, spans
