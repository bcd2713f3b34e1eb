"""Labelled phrases in five languages: the training material of the line, notice, language and personal-data models.

Written from general knowledge of web pages (towns, shops, museums, clubs, news). No phrase of two words or more stands
in the test tables (``tests/llm/test_material.py`` asserts it), so accuracy there is accuracy on unseen wording.
Slots: {N} an invented proper name, {d} a number, {date} a date, {C} a code, {F} a subject. Nothing here is matched as a
whole; the models generalise by words, letters and shape.
"""

from __future__ import annotations

import random

# Page furniture by language.
FURNITURE = {
    "en": [
        "Jump to the main navigation", "Jump to text", "Skip navigation", "Open navigation", "Toggle search", "Scroll to the top of page", "To the top", "Top of this page", "Follow, share or save this article", "Share with friends: Mail, Print, Bookmark", "Tweet Pin Send", "Share on social media", "Like Comment Subscribe",
        "Subscribe to the weekly newsletter! Register now", "Never miss a story: join our mailing list", "Was this article useful? Yes No", "Rate this article", "Send us your feedback", "Get the mobile app free of charge", "Download on the app store",
        "Our website uses cookies and similar technologies. By continuing you accept this. Learn more", "This website places cookies in your browser. Accept | Reject | Cookie settings", "We value your privacy. Agree and close", "Cookies help us to deliver our services. Got it!", "To make this website work, we store small data files on your computer. Fine",
        "Published {date}", "Posted by {N} on {date} in {F}", "{d} minutes to read", "Reading time: {d} minutes", "Written by the {N} editors, {date}", "Page last updated: {date}", "Last modified on {date}, {N} webmaster", "Updated {date}, online editors of {N}", "Author: {N} press office | {date}", "{d} views", "Page views: {d}", "{d} visitors so far", "{d} readers like this", "{d} comments", "{d} shares", "Shared {d} times",
        "Copyright {d} {N} Ltd. All rights are reserved.", "(c) {d}-{d} {N} Group, all rights reserved worldwide", "© {N} Media {d}", "{N} Museum. Serving our visitors since {d}", "{N} Town Hall: there for you since {d}", "No part of this website may be reproduced without written permission by {N}.", "Reprints need the prior approval of {N} Council.", "Information on this website is provided without guarantee; {N} Council is not liable for its accuracy.", "{N} accepts no responsibility for the information on these pages or on linked sites.", "All information without warranty.", "The content of these web pages serves general information, we accept no liability for errors or omissions.", "Reproduction and reuse need our consent in writing.", "No liability for the contents of external links.", "Most viewed", "Most shared", "Tell us what you think", "Recommend this page", "Back to the beginning", "Skip to the article",
        "Legal notice | Privacy policy | Cookie policy | Sitemap", "Terms of use · Data protection · Accessibility statement", "About | Press | Advertise | Careers | Help", "Keywords: {N}, {N}, {N}", "Labels: {N}; {N}; {N}", "Topics: {N} | {N} | {N}", "Filed under {F}, {N}, {N}", "#{N} #{N} #{N}", "More articles", "Further reading", "See also", "Similar articles", "More from this section", "Recommended for you", "Readers also liked", "Trending now", "Popular posts", "Top stories", "Quick links", "In this section", "You are here: {F} / {N}",
    ],
    "fr": [
        "Passer au texte", "Aller à la navigation", "Ouvrir la navigation", "Retour en haut", "Remonter", "Suivre, partager, enregistrer", "Partager avec vos amis : Courrier, Impression, Favoris", "Partager sur les réseaux sociaux", "Tweeter Épingler Envoyer", "Abonnez-vous à notre infolettre hebdomadaire ! Je m'abonne", "Ne manquez aucun article : inscrivez-vous", "Cet article vous a-t-il été utile ? Oui Non", "Donnez votre avis", "Téléchargez l'application mobile", "Application gratuite sur votre téléphone",
        "Notre site utilise des cookies et des technologies similaires. En poursuivant, vous acceptez. En savoir plus", "Ce site web place des cookies dans votre navigateur. Accepter | Refuser | Paramètres des cookies", "Nous respectons votre vie privée. Accepter et fermer", "Pour fonctionner, ce site enregistre des données sur votre ordinateur. Compris", "Paru le {date}", "Posté par {N} le {date} dans {F}", "Temps de lecture : {d} minutes", "{d} minutes", "Écrit par les rédacteurs de {N}, {date}", "Page modifiée le {date}", "Mis à jour le {date} par le webmestre de {N}", "Auteur : service de presse {N} | {date}", "{d} vues", "{d} visiteurs", "{d} lecteurs aiment cet article", "{d} commentaires", "Partagé {d} fois", "Nombre de consultations : {d}",
        "Copyright {d} {N} SA. Tous les droits sont réservés.", "© {N} Média {d}", "Musée {N}. Au service du public depuis {d}", "Mairie de {N} : à votre écoute depuis {d}", "Aucune partie de ce site ne peut être reproduite sans l'autorisation écrite de {N}.", "Toute reprise exige l'accord préalable de la mairie de {N}.", "Les informations de ce site sont fournies sans garantie ; la mairie de {N} décline toute responsabilité.", "{N} n'est pas responsable des informations de ces pages.", "Reproduction interdite sans accord écrit.", "Le contenu de ces pages est fourni à titre d'information générale, sans engager notre responsabilité.", "Les plus vus", "Les plus partagés", "Recommander la page", "{d} abonnés nous suivent", "Cela pourrait vous plaire", "Politique de confidentialité | Cookies | Conditions d'utilisation", "Protection des données · Plan · Aide · Presse", "Thèmes : {N}, {N}, {N}", "Sujets : {N}; {N}; {N}", "Classé dans {F}, {N}, {N}", "#{N} #{N} #{N}", "Autres articles", "Voir aussi", "Articles similaires", "Dans la même rubrique", "Recommandé pour vous", "Les articles populaires", "Tendances", "Accès rapides", "Vous êtes ici : {F} / {N}",
    ],
    "de": [
        "Direkt zum Text", "Zur Navigation wechseln", "Navigation öffnen", "Zum Seitenanfang", "Zurück zum Anfang", "Folgen, teilen, speichern", "Mit Freunden teilen: Mail, Druck, Lesezeichen", "In sozialen Netzwerken teilen", "Twittern Pinnen Senden", "Abonnieren Sie unseren wöchentlichen Newsletter! Hier anmelden", "Keinen Beitrag verpassen: gleich eintragen", "Fanden Sie den Artikel nützlich? Ja Nein", "Ihre Meinung zu dieser Seite", "App für das Handy herunterladen", "Kostenlose App holen",
        "Unsere Website nutzt Cookies und ähnliche Techniken. Mit der Nutzung stimmen Sie zu. Mehr erfahren", "Diese Website setzt Cookies in Ihrem Browser. Akzeptieren | Ablehnen | Cookie-Einstellungen", "Wir achten Ihre Privatsphäre. Zustimmen und schließen", "Damit die Website funktioniert, speichern wir Daten auf Ihrem Rechner. Einverstanden", "Erschienen am {date}", "Geschrieben von {N} am {date} in {F}", "Lesedauer: {d} Minuten", "{d} Minuten", "Verfasst von der Redaktion {N}, {date}", "Stand: {date}", "Zuletzt geändert am {date} vom Webmaster {N}", "Aktualisiert am {date} durch die Onlineredaktion {N}", "Autor: Pressestelle {N} | {date}", "{d} Aufrufe", "{d} Besucher", "{d} Lesern gefällt dieser Beitrag", "{d} Kommentare", "{d} Mal geteilt", "Seitenzugriffe: {d}",
        "Copyright {d} {N} GmbH. Alle Rechte sind vorbehalten.", "© {N} Medien {d}", "Museum {N}. Im Dienst der Besucher seit {d}", "Rathaus {N}: seit {d} nah am Bürger", "Kein Teil dieser Website darf ohne schriftliche Genehmigung von {N} vervielfältigt werden.", "Jede Übernahme bedarf der vorherigen Erlaubnis der Stadt {N}.", "Alle Angaben auf dieser Website ohne Gewähr; die Stadt {N} übernimmt keine Haftung.", "{N} ist für die Angaben auf diesen Seiten nicht verantwortlich.", "Nachdruck und Weitergabe nur mit schriftlicher Zustimmung.", "Der Inhalt der Seiten ist allgemeine Information, wir haften nicht für Fehler.", "Meist gesehen", "Meist geteilt", "Weiterempfehlen", "{d} Leute folgen uns", "Rechtliches | Datenschutzerklärung | Cookies | Nutzungsbedingungen", "Presse · Werbung · Hilfe · Sitemap", "Themen: {N}, {N}, {N}", "Stichworte: {N}; {N}; {N}", "Abgelegt unter {F}, {N}, {N}", "#{N} #{N} #{N}", "Weitere Artikel", "Siehe auch", "Ähnliche Beiträge", "Mehr aus diesem Bereich", "Empfohlen für Sie", "Beliebte Beiträge", "Im Trend", "Schnellzugriff", "Sie sind hier: {F} / {N}",
    ],
    "es": [
        "Ir al texto", "Ir a la navegación", "Abrir la navegación", "Subir al inicio", "Ir arriba", "Seguir, compartir, marcar", "Comparta con sus amigos: Mensaje, Impresión, Favoritos", "Compartir en redes sociales", "Tuitear Fijar Enviar", "¡Suscríbase a nuestro boletín semanal! Apuntarme", "No se pierda ningún artículo: regístrese", "¿Le resultó útil el artículo? Sí No", "Envíe su opinión", "Baje la aplicación para el móvil", "Aplicación gratuita en su teléfono",
        "Nuestra web utiliza cookies y técnicas similares. Si continúa, lo acepta. Más información", "Esta web coloca cookies en su navegador. Aceptar | Rechazar | Configurar cookies", "Respetamos su privacidad. Aceptar y cerrar", "Para funcionar, la web almacena datos en su ordenador. Entendido", "Aparecido el {date}", "Escrito por {N} el {date} en {F}", "Tiempo de lectura: {d} minutos", "{d} minutos", "Redactado por los editores de {N}, {date}", "Página modificada el {date}", "Actualizado el {date} por el administrador de {N}", "Autor: oficina de prensa {N} | {date}", "{d} vistas", "{d} visitantes", "A {d} lectores les gusta el artículo", "{d} comentarios", "Compartido {d} veces", "Número de visitas: {d}",
        "Copyright {d} {N} S.A. Quedan reservados todos los derechos.", "© {N} Medios {d}", "Museo {N}. Al servicio del público desde {d}", "Ayuntamiento de {N}: con usted desde {d}", "Ninguna parte de esta web puede reproducirse sin autorización escrita de {N}.", "Toda copia exige el permiso previo del ayuntamiento de {N}.", "La información de esta web se ofrece sin garantía; el ayuntamiento de {N} no es responsable de su exactitud.", "{N} no responde de la información de estas páginas.", "Prohibida la reproducción sin permiso escrito.", "El contenido de las páginas es información general, sin responsabilidad por errores.", "Lo más visto", "Lo más compartido", "Recomendar la página", "{d} personas nos siguen", "Política de privacidad | Cookies | Condiciones de uso", "Prensa · Publicidad · Ayuda · Protección de datos", "Temas: {N}, {N}, {N}", "Palabras clave: {N}; {N}; {N}", "Archivado en {F}, {N}, {N}", "#{N} #{N} #{N}", "Otros artículos", "Véase también", "Artículos similares", "En esta sección", "Recomendado para usted", "Artículos populares", "Tendencias", "Accesos rápidos", "Está usted en: {F} / {N}",
    ],
    "ar": [
        "تخطي إلى النص", "اذهب إلى شريط التنقل", "فتح شريط التنقل", "العودة إلى أعلى الصفحة", "إلى بداية الصفحة", "تابع وشارك واحفظ", "شارك مع أصدقائك: رسالة، طباعة، مفضلة", "المشاركة عبر الشبكات الاجتماعية", "غرد ثبت أرسل", "اشتركوا في رسالتنا الأسبوعية! سجل الآن", "لا يفوتكم أي مقال: سجلوا معنا", "هل كان المقال مفيدا؟ نعم لا", "أرسل رأيك", "نزل تطبيق الهاتف", "تطبيق مجاني على هاتفك",
        "يستخدم موقعنا ملفات تعريف الارتباط وتقنيات مشابهة. باستمرارك فأنت توافق. اعرف المزيد", "يضع هذا الموقع ملفات تعريف في متصفحك. قبول | رفض | إعدادات", "نحترم خصوصيتك. موافق وإغلاق", "كي يعمل الموقع نخزن بيانات على حاسوبك. فهمت", "صدر في {date}", "كتبه {N} يوم {date} في {F}", "مدة القراءة: {d} دقيقة", "{d} دقيقة", "حرره محررو {N}، {date}", "عدلت الصفحة يوم {date}", "حدثه مشرف {N} يوم {date}", "الكاتب: مكتب الصحافة {N} | {date}", "{d} مشاهدة", "{d} زائر", "نال المقال إعجاب {d} قارئا", "{d} تعليق", "تمت المشاركة {d} مرة", "عدد الزيارات: {d}",
        "حقوق النشر {d} شركة {N}. كل الحقوق محفوظة.", "© {N} للإعلام {d}", "متحف {N}. في خدمة الجمهور منذ {d}", "بلدية {N}: معكم منذ {d}", "لا يسمح بنسخ أي جزء من الموقع دون إذن خطي من {N}.", "كل إعادة نشر تحتاج إلى موافقة بلدية {N}.", "تقدم معلومات الموقع دون ضمان ولا تعد بلدية {N} مسؤولة عن دقتها.", "لا تتحمل {N} مسؤولية المعلومات في هذه الصفحات.", "يمنع النقل أو النسخ دون إذن.", "محتوى الصفحات معلومات عامة ولا مسؤولية عن الأخطاء.", "الأكثر مشاهدة", "الأكثر مشاركة", "أوصي بالصفحة", "يتابعنا {d} شخص", "اقرأ كذلك", "سياسة الخصوصية | ملفات التعريف | شروط الاستخدام", "الصحافة · الإعلانات · المساعدة · حماية البيانات", "مواضيع: {N}، {N}، {N}", "كلمات مفتاحية: {N}; {N}; {N}", "مصنف تحت {F}، {N}، {N}", "#{N} #{N} #{N}", "مقالات أخرى", "انظر أيضا", "مقالات مشابهة", "في هذا القسم", "مختارات لك", "مقالات شائعة", "الرائج الآن", "روابط سريعة", "أنت هنا: {F} / {N}",
    ],
}
# Entries of menus.
MENU = {
    "en": ["Start page", "Our story", "Visitors", "Departments", "Newsroom", "Shop", "Tickets", "Gallery", "Members", "Downloads", "Careers", "Sign in", "Support centre", "Opening times", "Getting here", "Press room"],
    "fr": ["Page de départ", "Notre histoire", "Visiteurs", "Services", "Salle de presse", "Boutique", "Billetterie", "Galerie", "Membres", "Téléchargements", "Carrières", "Se connecter", "Centre d'aide", "Heures d'ouverture", "Venir chez nous"],
    "de": ["Zur Startseite", "Unsere Geschichte", "Besucher", "Abteilungen", "Presseraum", "Laden", "Eintrittskarten", "Galerie", "Mitglieder", "Downloads", "Karriere", "Einloggen", "Hilfebereich", "Öffnungszeiten", "Anfahrt"],
    "es": ["Portada", "Nuestra historia", "Visitantes", "Departamentos", "Sala de prensa", "Tienda", "Entradas", "Galería", "Socios", "Descargas", "Carreras", "Iniciar sesión", "Centro de ayuda", "Horarios", "Cómo llegar"],
    "ar": ["صفحة البداية", "قصتنا", "الزوار", "الأقسام", "غرفة الصحافة", "المتجر", "التذاكر", "المعرض", "الأعضاء", "التنزيلات", "فرص العمل", "دخول", "مركز المساعدة", "أوقات العمل", "الوصول إلينا"],
}
# How pages are titled; a line like another page's title is an entry of a list of links.
TITLES = {
    "en": ["{N} in pictures", "Visit {N} this summer", "Ten facts about {N}", "{F} at {N}", "The {N} festival of {F}", "What to see in {N}", "Tickets for {C} and {N}", "{N}: an overview", "Prices of {N} {C}", "Meet {N}"],
    "fr": ["{N} en images", "Visiter {N} cet été", "Dix choses à savoir de {N}", "{F} à {N}", "Le festival {N} de {F}", "Que voir à {N}", "Billets pour {C} et {N}", "{N} : vue d'ensemble", "Les prix de {N} {C}", "Rencontre avec {N}"],
    "de": ["{N} in Bildern", "Ein Sommer in {N}", "Zehn Dinge über {N}", "{F} bei {N}", "Das Festival {N} für {F}", "Was man in {N} sieht", "Karten für {C} und {N}", "{N}: ein Überblick", "Preise von {N} {C}", "Begegnung mit {N}"],
    "es": ["{N} en imágenes", "Visitar {N} en verano", "Diez cosas de {N}", "{F} en {N}", "El festival {N} de {F}", "Qué ver en {N}", "Entradas para {C} y {N}", "{N}: vista general", "Los precios de {N} {C}", "Encuentro con {N}"],
    "ar": ["{N} في صور", "زيارة {N} في الصيف", "عشر معلومات عن {N}", "{F} في {N}", "مهرجان {N} في {F}", "ماذا ترى في {N}", "تذاكر {C} و {N}", "{N}: نظرة عامة", "أسعار {N} {C}", "لقاء مع {N}"],
}
FIELDS = {
    "en": ["Bird Watching", "Modern Sculpture", "Garden Design", "Railway History", "Folk Music", "Bread Baking", "Mountain Rescue", "Water Supply"],
    "fr": ["sculpture moderne", "histoire des chemins de fer", "musique folklorique", "jardinage", "secours en montagne", "boulangerie artisanale"],
    "de": ["Moderne Bildhauerei", "Eisenbahngeschichte", "Volksmusik", "Gartenbau", "Bergrettung", "Brotbacken"],
    "es": ["escultura moderna", "historia del ferrocarril", "música popular", "jardinería", "rescate de montaña", "panadería artesanal"],
    "ar": ["النحت الحديث", "تاريخ السكك الحديدية", "الموسيقى الشعبية", "تنسيق الحدائق", "الإنقاذ الجبلي", "صناعة الخبز"],
}
# Short lines of main text: headings (first group), entries of lists, rows, single sentences.
HEADINGS = {
    "en": ["The story of {N}", "{d} reasons to visit {N}", "How to prepare for {C}", "Opening hours and prices", "Where {N} comes from", "Results of {N} in {F}", "Instructions for {C}", "{N} at a glance", "Why {F} needs {N}"],
    "fr": ["L'histoire de {N}", "{d} raisons de visiter {N}", "Comment préparer {C}", "Tarifs et heures", "D'où vient {N}", "Bilan de {N} en {F}", "Instructions pour {C}", "{N} en bref", "Pourquoi {F} a besoin de {N}"],
    "de": ["Die Geschichte von {N}", "{d} Gründe für {N}", "Vorbereitung auf {C}", "Zeiten und Preise", "Woher {N} kommt", "Ergebnisse von {N} in {F}", "Anleitung für {C}", "{N} im Überblick", "Warum {F} auf {N} baut"],
    "es": ["La historia de {N}", "{d} razones para visitar {N}", "Cómo preparar {C}", "Horas y precios", "De dónde viene {N}", "Balance de {N} en {F}", "Instrucciones para {C}", "{N} de un vistazo", "{F} necesita a {N}"],
    "ar": ["حكاية {N}", "{d} أسباب لزيارة {N}", "كيف تستعد إلى {C}", "الأوقات والأسعار", "من أين جاء {N}", "نتائج {N} في {F}", "إرشادات {C}", "{N} باختصار", "لماذا تحتاج {F} إلى {N}"],
}
ENTRIES = {
    "en": ["a copy of permit {C}", "two photographs of {N}", "the receipt of {N} for {d} items", "a warm coat for the {N} tour", "{d} tickets to {F} with {N}", "map {d} showing {N}", "one seat on coach {d} to {N}", "a letter from {N} about {C}"],
    "fr": ["une copie du permis {C}", "deux photos de {N}", "le reçu de {N} pour {d} articles", "un manteau pour la visite {N}", "{d} billets de {F} avec {N}", "la carte {d} du quartier {N}", "un siège dans le car {d} vers {N}", "une lettre de {N} sur {C}"],
    "de": ["eine Kopie der Genehmigung {C}", "zwei Fotos von {N}", "die Quittung von {N} über {d} Stück", "ein warmer Mantel für die Tour {N}", "{d} Karten für {F} mit {N}", "Karte {d} des Bezirks {N}", "ein Sitz im Wagen {d} nach {N}", "ein Brief von {N} zu {C}"],
    "es": ["una copia del permiso {C}", "dos fotos de {N}", "el recibo de {N} por {d} artículos", "un abrigo para la visita {N}", "{d} entradas de {F} con {N}", "el mapa {d} del barrio {N}", "un asiento en el coche {d} a {N}", "una carta de {N} sobre {C}"],
    "ar": ["نسخة من التصريح {C}", "صورتان من {N}", "إيصال {N} عن {d} قطعة", "معطف دافئ لجولة {N}", "{d} تذاكر {F} مع {N}", "خريطة {d} لحي {N}", "كرسي في العربة {d} إلى {N}", "بطاقة أرسلتها {N} عن {C}"],
}
SINGLES = {
    "en": ["The kitchen closes an hour before the house does.", "Dogs are welcome on a short lead.", "Parcel {C} is still at the post office.", "Bridge {d} is shut until {d}.", "The {N} archive holds {d} letters.", "Bill {d} was paid for {d} months.", "Tram {d} turns at {N} Square, close to gate {d}.", "Ask Ms {N} for the keys of house {d}.", "A guide tells visitors what code {d} on the meter means.", "The evening class teaches how a browser runs scripts.", "Please bring good shoes and something to drink.", "Children under six travel free.", "Write the code {C} on the back of the form.", "The {N} Medal went to team {C}.", "The museum keeps its cookies recipe of {d} in a glass case."],
    "fr": ["La cuisine ferme une heure avant la maison.", "Les chiens sont les bienvenus en laisse.", "Le colis {C} est encore à la poste.", "Le pont {d} est coupé jusqu'à {d}.", "Le grenier {N} compte {d} lettres.", "La note {d} a été payée pour {d} mois.", "Le tram {d} tourne place {N}, près de la porte {d}.", "Demandez à Mme {N} les clés de la maison {d}.", "Un guide dit aux visiteurs ce que signifie le code {d} du compteur.", "Prévoyez de bonnes chaussures et de l'eau.", "Les enfants de moins de six ans voyagent gratuitement.", "La médaille {N} est allée à l'équipe {C}."],
    "de": ["Die Küche schließt eine Stunde vor dem Haus.", "Hunde an kurzer Leine sind willkommen.", "Das Paket {C} liegt noch bei der Post.", "Brücke {d} bleibt bis {d} gesperrt.", "Der Speicher {N} besitzt {d} Briefe.", "Der Beleg {d} wurde für {d} Monate bezahlt.", "Tram {d} wendet am Platz {N}, nahe Tor {d}.", "Fragen Sie Frau {N} nach den Schlüsseln für Haus {d}.", "Ein Führer sagt den Gästen, was der Code {d} am Zähler heißt.", "Gute Schuhe und etwas zu trinken gehören ins Gepäck.", "Kinder unter sechs fahren umsonst.", "Die Medaille {N} ging an Mannschaft {C}."],
    "es": ["La cocina cierra una hora antes que la casa.", "Los perros pueden entrar con correa corta.", "El paquete {C} sigue en la oficina de correos.", "El puente {d} está cortado hasta {d}.", "El desván {N} posee {d} cartas.", "El recibo {d} se pagó por {d} meses.", "El tranvía {d} gira en la plaza {N}, junto a la puerta {d}.", "Pida a la señora {N} las llaves de la casa {d}.", "Un guía cuenta a los visitantes qué significa el código {d} del contador.", "Lleve buen calzado y algo de beber.", "Los niños menores de seis años viajan gratis.", "La medalla {N} fue para el equipo {C}."],
    "ar": ["يغلق المطبخ قبل البيت بساعة.", "يسمح بدخول الكلاب برباط قصير.", "ما زال الطرد {C} في مكتب البريد.", "الجسر {d} مغلق حتى {d}.", "يضم أرشيف {N} عدد {d} رسالة.", "دفع الإيصال {d} عن {d} شهرا.", "يدور الترام {d} عند ساحة {N} قرب البوابة {d}.", "اطلبوا مفاتيح البيت {d} من السيدة {N}.", "يشرح المرشد للزوار معنى الرمز {d} على العداد.", "أحضروا حذاء جيدا وشيئا للشرب.", "يسافر الأطفال دون السادسة مجانا.", "ذهب وسام {N} إلى الفريق {C}."],
}
# Titles of pages that failed.
FAILED = {"en": ["HTTP 404", "Nothing here", "Server problem"], "fr": ["HTTP 404", "Rien ici", "Problème de serveur"], "de": ["HTTP 404", "Nichts hier", "Serverproblem"], "es": ["HTTP 404", "Nada aquí", "Problema del servidor"], "ar": ["HTTP 404", "لا شيء هنا", "مشكلة في الخادم"]}
# Whole bodies of pages that failed, want scripts or check for robots.
NOTICES = {
    "en": ["HTTP error {d}", "Error {d}: file or directory not found", "{d}: this URL was not found on our server.", "We can't find the page you requested. It may have been moved or deleted.", "The document you are looking for may have been removed, renamed or is unavailable.", "The link you followed is broken or the page was deleted.", "Whoops, nothing lives at this link.", "This content is no longer available.", "Error {d}. The server encountered an unexpected condition. Try reloading the page in a few minutes.", "Application error: a server-side exception has occurred.", "An unexpected error has occurred. Our engineers have been informed, please retry.", "Something broke on the server. Try reloading.",
           "You are not authorised to access this document. Ask the administrator for permission.", "{d} Forbidden. Access to this directory is blocked by the administrator.", "Permission required: your account cannot open this document.", "JavaScript is disabled. Turn it on and reload.", "This site relies on JavaScript. Switch it on in the settings of your browser and reload.", "Your browser has JavaScript turned off; the content cannot load.", "Enable scripts and reload to continue.", "The app could not start because scripting is blocked in this browser.", "Your browser is too old for this application. Upgrade to a current version that runs scripts.", "Still loading? Allow scripts for this site.", "Loading the content, one moment. Scripts have to be allowed for that.",
           "Prove that you are a human: tick the box below.", "Verifying your browser before you proceed. Please allow cookies and JavaScript.", "Security check: we need to make sure you are a person and no bot.", "Unusual traffic from your network. Solve the captcha to go on.", "Could not connect to the database server.", "Database connection failed: too many connections", "SQL error: unable to select database", "Fatal error: Uncaught exception in /var/www/html/index.php on line {d}", "Notice: undefined variable in /home/site/public/header.php on line {d}", "{d} Gateway Timeout", "Connection timed out while waiting for the upstream server (code {d}).", "Request timed out. The server took too long to respond.", "Scheduled maintenance: we will be back shortly.", "We are upgrading the system. Please come back later.", "The service is offline for repairs (error {d}).", "You have been logged out because of inactivity. Log in again."],
    "fr": ["Erreur HTTP {d}", "Ce document est introuvable ou a été supprimé.", "L'adresse saisie n'existe pas sur notre serveur (code {d}).", "Nous ne trouvons pas la page voulue. Elle a peut-être été déplacée.", "Le lien suivi est cassé.", "Erreur {d}. Le serveur a rencontré un problème inattendu, réessayez dans quelques minutes.", "Une erreur inattendue est survenue. Rechargez la page.", "Vous n'êtes pas autorisé à consulter ce document. Demandez la permission à l'administrateur.", "Interdit : l'accès à ce dossier est bloqué.", "JavaScript est désactivé. Activez-le puis rechargez.", "Ce site a besoin de JavaScript : activez-le dans votre navigateur.", "Le contenu ne se charge pas car les scripts sont bloqués dans ce navigateur.", "Votre navigateur est trop ancien, mettez-le à jour.", "Prouvez que vous êtes humain et non un robot.", "Vérification du navigateur en cours. Autorisez cookies et scripts.", "Connexion impossible à la base de données.", "Le serveur a mis trop de temps à répondre.", "Maintenance en cours : revenez plus tard.", "Service hors ligne pour travaux."],
    "de": ["HTTP-Fehler {d}", "Dieses Dokument wurde nicht gefunden oder gelöscht.", "Die eingegebene Adresse existiert auf unserem Server nicht (Code {d}).", "Wir können die Seite nicht finden. Vielleicht wurde sie verschoben.", "Der Link ist leider defekt.", "Fehler {d}. Auf dem Server ist ein unerwartetes Problem aufgetreten, laden Sie in einigen Minuten neu.", "Es ist ein unerwarteter Fehler aufgetreten. Laden Sie die Seite neu.", "Sie sind nicht berechtigt, dieses Dokument zu öffnen. Fragen Sie den Administrator.", "Verboten: Der Zugang zu diesem Ordner ist gesperrt.", "JavaScript ist ausgeschaltet. Aktivieren Sie es und laden Sie neu.", "Diese Website braucht JavaScript: aktivieren Sie es im Browser.", "Der Inhalt lädt nicht, weil Skripte in diesem Browser gesperrt sind.", "Ihr Browser ist zu alt, bitte aktualisieren.", "Beweisen Sie, dass Sie ein Mensch und kein Roboter sind.", "Ihr Browser wird geprüft. Erlauben Sie Cookies und Skripte.", "Keine Verbindung zur Datenbank möglich.", "Der Server hat zu lange nicht geantwortet.", "Wartungsarbeiten: kommen Sie später wieder.", "Dienst wegen Arbeiten offline."],
    "es": ["Error HTTP {d}", "Este documento no se encuentra o fue borrado.", "La dirección escrita no existe en nuestro servidor (código {d}).", "No podemos encontrar la página. Quizá se ha movido.", "El enlace está roto.", "Error {d}. El servidor encontró un problema inesperado, vuelva a intentarlo en unos minutos.", "Ha ocurrido un error inesperado. Recargue la página.", "No está autorizado a abrir este documento. Pida permiso al administrador.", "Prohibido: el acceso a esta carpeta está bloqueado.", "JavaScript está desactivado. Actívelo y recargue.", "Esta web necesita JavaScript: actívelo en el navegador.", "El contenido no carga porque los scripts están bloqueados en este navegador.", "Su navegador es demasiado antiguo, actualícelo.", "Demuestre que es una persona y no un robot.", "Estamos verificando su navegador. Permita cookies y scripts.", "No se pudo conectar con la base de datos.", "El servidor tardó demasiado en responder.", "Mantenimiento en curso: vuelva más tarde.", "Servicio fuera de línea por trabajos."],
    "ar": ["خطأ HTTP {d}", "لم يعثر على هذا المستند أو تم حذفه.", "العنوان الذي كتبته غير موجود على خادمنا (الرمز {d}).", "لا نستطيع إيجاد الصفحة. ربما تم نقلها.", "الرابط معطل.", "خطأ {d}. واجه الخادم مشكلة غير متوقعة، أعد المحاولة بعد دقائق.", "وقع خطأ غير متوقع. أعد تحميل الصفحة.", "غير مصرح لك بفتح هذا المستند. اطلب الإذن من المشرف.", "ممنوع: الدخول إلى هذا المجلد محظور.", "جافا سكريبت معطلة. فعلها ثم أعد التحميل.", "يحتاج هذا الموقع إلى جافا سكريبت: فعلها في المتصفح.", "لا يتم تحميل المحتوى لأن البرامج محظورة في هذا المتصفح.", "متصفحك قديم جدا، حدثه.", "أثبت أنك إنسان ولست آلة.", "جار فحص المتصفح. اسمح بملفات التعريف والبرامج.", "تعذر الاتصال بقاعدة البيانات.", "استغرق الخادم وقتا طويلا في الرد.", "أعمال صيانة: عودوا لاحقا.", "الخدمة متوقفة بسبب أعمال."],
}
# Filler text other than scrambled Latin.
FILLERS = {
    "en": ["This is dummy text. It only shows how the page will look.", "Dummy copy for preview purposes only.", "Your headline goes in this place, your paragraph goes below.", "Enter your content in this field.", "Sample paragraph, please replace before publishing.", "Type something here. Add more text later.", "Replace the sample paragraph with real copy.", "Text to follow. More text to follow. Text to follow.", "tba tba tba text coming soon tba", "Write a short description of your company here.", "Edit me! Double click to add your own content.", "The quick brown fox jumps over the lazy dog. The quick brown fox jumps over the lazy dog.", "foo bar baz foo bar baz", "test test test test test", "blah blah blah blah"],
    "fr": ["Ceci est un faux texte. Il montre seulement l'aspect de la page.", "Placez votre contenu dans ce champ.", "Paragraphe d'exemple à remplacer avant publication.", "Écrivez quelque chose ici. Ajoutez du texte plus tard.", "Remplacez l'exemple par un vrai texte.", "Texte à suivre. Texte à suivre.", "Votre titre à cet endroit, votre paragraphe en dessous.", "Décrivez votre société ici en quelques mots.", "Modifiez ce bloc pour ajouter votre propre contenu."],
    "de": ["Dies ist ein Platzhaltertext. Er zeigt nur, wie die Seite aussieht.", "Geben Sie in diesem Feld Ihren Inhalt ein.", "Beispielabsatz, vor der Veröffentlichung zu ersetzen.", "Schreiben Sie hier etwas. Später mehr Text einfügen.", "Ersetzen Sie das Beispiel durch echten Text.", "Text folgt noch. Text folgt noch.", "An dieser Stelle Ihre Überschrift, darunter Ihr Absatz.", "Beschreiben Sie hier kurz Ihre Firma.", "Bearbeiten Sie diesen Block und fügen Sie eigene Inhalte ein."],
    "es": ["Este es un texto ficticio. Solo muestra el aspecto de la página.", "Ponga su contenido en este campo.", "Párrafo de ejemplo, cámbielo antes de publicar.", "Escriba algo aquí. Añada más texto luego.", "Cambie el ejemplo por un texto real.", "Texto por venir. Texto por venir.", "Su titular en este lugar, su párrafo debajo.", "Describa aquí su empresa en pocas palabras.", "Edite este bloque para añadir su propio contenido."],
    "ar": ["هذا نص وهمي. يوضح شكل الصفحة فقط.", "أدخل محتواك في هذا الحقل.", "فقرة للتجربة، غيرها قبل النشر.", "اكتب شيئا هنا. أضف نصا آخر لاحقا.", "استبدل المثال بنص حقيقي.", "النص قادم. النص قادم.", "عنوانك في هذا المكان وفقرتك تحته.", "صف شركتك هنا بكلمات قليلة.", "عدل هذه الخانة لإضافة محتواك الخاص."],
}
# Real sentences that talk about errors, scripts, robots and drafts.
TALK = {
    "en": ["The mechanic explains to drivers what error {d} on the dashboard means.", "In the evening class we learn how a script runs in the browser and why some people block it.", "Typesetters once used dummy text to test a new typeface, says the guide.", "The exhibition shows a robot that was denied access to the factory in {d}.", "Fill in the template by hand and send it to {N} before Friday.", "The baker keeps no cookies after closing, and the shop is closed for maintenance every March.", "Visitors learn why the server of {N} was down in {d} and who repaired the database.", "The author left the title empty on purpose so that readers write their own."],
    "fr": ["Le mécanicien dit aux conducteurs ce que veut dire l'erreur {d} du tableau.", "Au cours du soir on apprend comment un script tourne dans le navigateur.", "Les typographes prenaient jadis un faux texte pour essayer une police, dit le guide.", "L'exposition montre un robot auquel on refusa l'accès en {d}.", "Remplissez le modèle à la main et envoyez-le à {N} avant vendredi.", "On apprend pourquoi le serveur de {N} était en panne en {d}."],
    "de": ["Der Mechaniker sagt den Fahrern, was Fehler {d} auf der Anzeige heißt.", "Im Abendkurs lernt man, wie ein Skript im Browser läuft.", "Setzer nahmen früher Blindtext, um eine Schrift zu proben, sagt der Führer.", "Die Ausstellung zeigt einen Roboter, dem {d} der Zugang verweigert wurde.", "Füllen Sie die Vorlage von Hand aus und schicken Sie sie vor Freitag an {N}.", "Man erfährt, warum der Server von {N} anno {d} ausfiel."],
    "es": ["El mecánico dice a los conductores qué significa el error {d} del tablero.", "En la clase nocturna se aprende cómo corre un script en el navegador.", "Los tipógrafos usaban antes un texto ficticio para probar una letra, dice el guía.", "La exposición muestra un robot al que se negó el acceso en {d}.", "Rellene la plantilla a mano y envíela a {N} antes del viernes.", "Se cuenta por qué el servidor de {N} se cayó en {d}."],
    "ar": ["يشرح الميكانيكي للسائقين معنى الخطأ {d} على اللوحة.", "نتعلم في الدرس المسائي كيف تعمل البرامج في المتصفح.", "كان الطباعون يستعملون نصا وهميا لتجربة الخط كما يقول المرشد.", "يعرض المعرض آلة رفض دخولها إلى المصنع عام {d}.", "املأ النموذج باليد وأرسله إلى {N} قبل الجمعة.", "يعرف الزوار لماذا توقف خادم {N} عام {d}."],
}
LATIN = ("Ba", "Li", "Mer", "Kor", "Tam", "Pel", "Sor", "Ro", "Dov", "Fen", "Gal", "Hes", "Wil", "Qua", "Jen", "Ost"), ("an", "el", "ora", "ib", "em", "ust", "inn", "ard", "ev"), ("rick", "mond", "dale", "sen", "via", "burg", "low", "ton", "ska", "rud", "ez", "ier")
ARABIC = ("عا", "نـ", "در", "بو", "شا", "حم", "رز", "ما"), ("ري", "ول", "ين", "اس", "مد"), ("ان", "وي", "ار", "ين", "يد", "اط")


def fill(template: str, lang: str, rnd: random.Random) -> str:
    """``template`` with its slots filled by invented values."""

    def name(_=None) -> str:
        parts = ARABIC if lang == "ar" and rnd.random() < 0.6 else LATIN
        return "".join(rnd.choice(p) for p in parts).replace("ـ", "")

    out = template
    while "{N}" in out:
        out = out.replace("{N}", name(), 1)
    while "{C}" in out:
        out = out.replace("{C}", rnd.choice(["AB", "PK", "WT", "ZED", "TRM", "Q", "KX-"]) + rnd.choice(["", " ", "-"]) + str(rnd.randint(100, 9999)), 1)
    while "{date}" in out:
        y, m, d = rnd.randint(2009, 2026), rnd.randint(1, 12), rnd.randint(1, 28)
        out = out.replace("{date}", rnd.choice([f"{y}-{m:02}-{d:02}", f"{d:02}/{m:02}/{y}", f"{d:02}.{m:02}.{y}", f"{d}.{m}.{y}"]), 1)
    while "{d}" in out:
        out = out.replace("{d}", str(rnd.choice([rnd.randint(1, 99), rnd.randint(100, 9999), rnd.randint(1950, 2024)])), 1)
    if "{F}" in out:
        out = out.replace("{F}", rnd.choice(FIELDS[lang]))
    return out.replace("{{", "{").replace("}}", "}")


# Parts of plain sentences (who, does, what, how), for training prose against everything else.
PROSE = {
    "en": (
        ["The harbour master", "Our oldest baker", "The night watch", "A farmer near {N}", "Two sisters from {N}", "The {N} football club", "The ministry of {F}", "A nurse with ten years of practice", "According to the report, the town council", "Nobody doubts that the ferry company", "Whenever it rains, the gardener", "Before the war, a small factory", "Although tickets are cheap, the orchestra", "In spring, the mountain railway", "It turned out that the owner of {N}", "My neighbour", "They say the fire brigade", "While tourists sleep, the street cleaner"],
        ["has repaired", "likes to paint", "used to sell", "wants to rebuild", "never forgot", "is about to open", "could not find", "had to close", "often describes", "sends back", "decided to measure", "was allowed to borrow"],
        ["the wooden bridge", "an old map of the coast", "more than {d} crates of apples", "the windows of the chapel", "a bicycle with three wheels", "the secret of good soup", "its collection of clocks", "every boat in the bay", "the story of the lost key", "what the visitors had left behind", "the road between {N} and the sea", "new shoes for the whole team", "a letter that nobody could read"],
        ["before the snow melts", "because the old one had burned down", "with tools from the cellar", "in front of a large crowd", "for less than {d} coins", "although nobody had asked for it", "since the summer of {d}", "and then went home on foot", "so that children can play there", "as long as the weather holds", "when the market is over", "if the neighbours agree", "thanks to a gift from {N}"],
    ),
    "fr": (
        ["Le capitaine du port", "Notre plus vieux boulanger", "Un fermier près de {N}", "Deux sœurs venues de {N}", "Le club de football {N}", "Le ministère de {F}", "Une infirmière qui travaille ici", "Selon le rapport, le conseil municipal", "Quand il pleut, le jardinier", "Avant la guerre, une petite usine", "Bien que les billets soient bon marché, l'orchestre", "Au printemps, le train de montagne", "On dit que les pompiers", "Mon voisin", "Pendant que les touristes dorment, le balayeur", "Il paraît que le propriétaire de {N}"],
        ["a réparé", "aime peindre", "vendait autrefois", "veut reconstruire", "n'a jamais oublié", "est sur le point d'ouvrir", "ne pouvait trouver", "a dû fermer", "décrit souvent", "renvoie toujours", "a décidé de mesurer"],
        ["le pont de bois", "une vieille carte de la côte", "plus de {d} caisses de pommes", "les fenêtres de la chapelle", "une bicyclette à trois roues", "le secret d'une bonne soupe", "sa collection d'horloges", "chaque bateau de la baie", "l'histoire de la clé perdue", "ce que les visiteurs avaient laissé", "la route entre {N} et la mer", "des chaussures neuves pour toute l'équipe"],
        ["avant que la neige ne fonde", "parce que l'ancien avait brûlé", "avec des outils de la cave", "devant une grande foule", "pour moins de {d} pièces", "alors que personne ne l'avait demandé", "depuis l'été de {d}", "puis est rentré à pied", "pour que les enfants y jouent", "tant que le temps le permet", "quand le marché est fini", "grâce à un cadeau de {N}"],
    ),
    "de": (
        ["Der Hafenmeister", "Unser ältester Bäcker", "Ein Bauer bei {N}", "Zwei Schwestern aus {N}", "Der Fußballverein {N}", "Das Ministerium für {F}", "Eine Krankenschwester mit viel Erfahrung", "Laut Bericht hat der Gemeinderat", "Wenn es regnet, hat der Gärtner", "Vor dem Krieg hat eine kleine Fabrik", "Obwohl die Karten billig sind, hat das Orchester", "Im Frühling hat die Bergbahn", "Man sagt, die Feuerwehr habe", "Mein Nachbar hat", "Während die Gäste schlafen, hat der Straßenkehrer", "Es heißt, der Besitzer von {N} habe"],
        ["gestern", "schon immer", "nur selten", "damals", "aus Versehen", "zum ersten Mal", "noch nie", "heimlich", "ganz allein", "mit Freude", "trotzdem"],
        ["die hölzerne Brücke", "eine alte Landkarte der Küste", "mehr als {d} Kisten Äpfel", "die Fenster der Kapelle", "ein Fahrrad mit drei Rädern", "das Geheimnis einer guten Suppe", "seine Sammlung von Uhren", "jedes Boot in der Bucht", "den verlorenen Schlüssel", "was die Besucher liegen ließen", "den Weg zwischen {N} und dem Meer", "neue Schuhe für die ganze Mannschaft"],
        ["repariert, bevor der Schnee schmilzt", "gemalt, weil das alte Haus abgebrannt war", "mit Werkzeug aus dem Keller gebaut", "vor einer großen Menge gezeigt", "für weniger als {d} Münzen verkauft", "gesucht, obwohl niemand darum gebeten hatte", "seit dem Sommer {d} nicht mehr gesehen", "vergessen und ging zu Fuß heim", "geöffnet, damit die Kinder dort spielen", "gemessen, solange das Wetter hält", "abgeholt, wenn der Markt vorbei ist", "dank eines Geschenks von {N} bekommen"],
    ),
    "es": (
        ["El capitán del puerto", "Nuestro panadero más viejo", "Un granjero cerca de {N}", "Dos hermanas de {N}", "El club de fútbol {N}", "El ministerio de {F}", "Una enfermera que trabaja aquí", "Según el informe, el concejo municipal", "Cuando llueve, el jardinero", "Antes de la guerra, una pequeña fábrica", "Aunque los billetes son baratos, la orquesta", "En primavera, el tren de montaña", "Dicen que los bomberos", "Mi vecino", "Mientras los turistas duermen, el barrendero", "Parece que el dueño de {N}"],
        ["ha reparado", "suele pintar", "vendía antes", "quiere reconstruir", "nunca olvidó", "está a punto de abrir", "no pudo encontrar", "tuvo que cerrar", "describe a menudo", "devuelve siempre", "decidió medir"],
        ["el puente de madera", "un viejo mapa de la costa", "más de {d} cajas de manzanas", "las ventanas de la capilla", "una bicicleta de tres ruedas", "el secreto de una buena sopa", "su colección de relojes", "cada barco de la bahía", "la historia de la llave perdida", "lo que los visitantes habían dejado", "el camino entre {N} y el mar", "zapatos nuevos para todo el equipo"],
        ["antes de que se derrita la nieve", "porque el viejo se había quemado", "con herramientas del sótano", "ante mucha gente", "por menos de {d} monedas", "aunque nadie lo había pedido", "desde el verano de {d}", "y luego volvió a casa andando", "para que los niños jueguen allí", "mientras el tiempo lo permita", "cuando termina el mercado", "gracias a un regalo de {N}"],
    ),
    "ar": (
        ["أصلح قبطان الميناء", "باع أقدم خباز عندنا", "رسم فلاح قرب {N}", "وجدت أختان من {N}", "اشترى نادي الكرة {N}", "وصفت وزارة {F}", "حملت ممرضة تعمل هنا", "ذكر التقرير أن مجلس المدينة أعاد", "كلما نزل المطر غطى البستاني", "قبل الحرب صنع معمل صغير", "مع أن الأسعار رخيصة عرضت الفرقة", "في الربيع ينقل قطار الجبل", "يقال إن رجال الإطفاء فتحوا", "لم ينس جاري", "بينما ينام السياح ينظف العامل", "يبدو أن صاحب {N} أغلق"],
        ["أمس", "دائما", "بهدوء", "وحده", "للمرة الأولى", "بفرح", "سرا", "ذات يوم", "فجأة"],
        ["الجسر الخشبي", "خريطة قديمة للساحل", "أكثر من {d} صندوقا من التفاح", "نوافذ القلعة", "دراجة بثلاث عجلات", "سر الحساء اللذيذ", "مجموعة من الساعات", "كل قارب في الخليج", "قصة المفتاح الضائع", "ما تركه الضيوف وراءهم", "الطريق بين {N} والبحر", "أحذية جديدة للاعبين"],
        ["قبل أن يذوب الثلج", "لأن القديم قد احترق", "بأدوات من القبو", "أمام جمهور كبير", "بأقل من {d} قطعة نقدية", "رغم أن أحدا لم يطلب ذلك", "منذ صيف {d}", "ثم عاد إلى بيته ماشيا", "كي يلعب الأطفال هناك", "ما دام الجو جميلا", "حين ينتهي السوق", "بفضل هدية من {N}"],
    ),
}
# Parts of sentences with modal verbs, requests and relations of time.
MODAL = {
    "en": (["A pilot", "The geese", "Every guest of {N}", "Your grandmother", "The second violin", "Whoever finds the ring", "Each driver on route {d}", "In winter the lighthouse keeper", "To reach {N}, one", "The players"], ["must", "can", "may", "should", "will", "could", "have to", "is able to", "is about to", "ought to"],
           ["feed the horses", "refuse the offer and wait", "bring a lamp", "taste the soup", "leave the valley", "sing two songs about {N}", "count {d} sheep", "cross the river on foot", "carry the piano upstairs", "explain the rules of {F}", "compare both maps"], ["after dark", "before breakfast", "at the end of the pier", "with the help of a rope", "within {d} hours", "on the first floor", "if the wind allows", "while the others rest", "from {d} onwards", "without a word", "by boat or by train"]),
    "fr": (["Le pilote", "Chaque hôte de {N}", "Votre grand-mère", "Le second violon", "Celui qui trouve la bague", "En hiver le gardien du phare", "Chaque conducteur de la ligne {d}", "Les joueurs de {N}"], ["doit", "peut", "va", "devrait", "pourrait", "souhaite", "veut", "vient de", "est capable de"],
           ["nourrir les chevaux", "refuser l'offre et attendre", "apporter une lampe", "goûter la soupe", "quitter la vallée", "chanter deux chansons sur {N}", "compter {d} moutons", "traverser la rivière à pied", "porter le piano", "enseigner les règles de {F}", "comparer les deux cartes"], ["à la nuit tombée", "avant le petit déjeuner", "au bout de la jetée", "avec l'aide d'une corde", "en {d} heures", "au premier étage", "si le vent le permet", "pendant que les autres dorment", "à partir de {d}", "sans un mot", "par bateau ou par train"]),
    "de": (["Der Pilot", "Jeder Gast von {N}", "Deine Großmutter", "Die zweite Geige", "Wer den Ring findet,", "Im Winter", "Jede Fahrerin der Linie {d}", "Die Mannschaft {N}"], ["muss", "kann", "darf", "soll", "wird", "könnte", "möchte", "will", "sollte"],
           ["die Pferde", "das Angebot", "eine Lampe", "die heiße Suppe", "das stille Tal", "zwei Lieder über {N}", "mehr als {d} Schafe", "den breiten Fluss", "das Klavier", "die Regeln für {F}", "beide Landkarten"], ["nach Einbruch der Dunkelheit füttern", "vor dem Frühstück ablehnen", "am Ende des Stegs zeigen", "mit Hilfe eines Seils tragen", "binnen {d} Stunden finden", "im ersten Stock vergleichen", "erklären, wenn der Wind es zulässt", "singen, während die anderen ruhen", "ab {d} verlassen", "ohne ein Wort überqueren", "mit Schiff oder Bahn erreichen"]),
    "es": (["El piloto", "Cada huésped de {N}", "Tu abuela", "El segundo violín", "Quien encuentre el anillo", "En invierno el guarda del faro", "Cada conductor de la línea {d}", "Las jugadoras de {N}"], ["debe", "puede", "va a", "debería", "podría", "quiere", "desea", "tiene que", "acaba de"],
           ["alimentar a los caballos", "rechazar la oferta y esperar", "traer una lámpara", "probar la sopa", "dejar el valle", "cantar dos canciones sobre {N}", "contar {d} ovejas", "cruzar el río a pie", "subir el piano", "explicar las reglas de {F}", "comparar ambos mapas"], ["al caer la noche", "antes del desayuno", "al final del muelle", "con ayuda de una cuerda", "en {d} horas", "en el primer piso", "si el viento lo permite", "mientras los demás descansan", "a partir de {d}", "sin decir nada", "en barco o en tren"]),
    "ar": (["على الطيار أن", "يستطيع كل ضيف في {N} أن", "تريد جدتك أن", "يجب على العازف الثاني أن", "من يجد الخاتم يمكنه أن", "في الشتاء يفضل حارس المنارة أن", "ينوي سائق الخط {d} أن", "يبدأ لاعبو {N} ثم"], ["يطعم الخيول", "يرفض العرض وينتظر", "يحضر مصباحا", "يذوق الحساء", "يغادر الوادي", "يغني أغنيتين عن {N}", "يعد {d} خروفا", "يعبر النهر ماشيا", "يحمل البيانو", "يشرح قواعد {F}", "يقارن بين الخريطتين"], ["بعد حلول الظلام", "قبل الفطور", "في آخر الرصيف", "بمساعدة حبل", "خلال {d} ساعات", "في الطابق الأول", "إذا سمحت الريح", "بينما يستريح الآخرون", "ابتداء من عام {d}", "دون كلمة", "بالسفينة أو القطار"]),
}
# Sentences in further languages, which are labelled "other".
OTHER = {
    "pt": ["O gato dorme em cima da mesa da cozinha.", "Ontem não fomos à praia porque chovia muito.", "A minha irmã comprou uma bicicleta nova para os filhos.", "Você já viu onde ficam as chaves do carro?", "Os pescadores voltaram ao porto com poucas sardinhas."],
    "it": ["Il gatto dorme sopra il tavolo della cucina.", "Ieri non siamo andati al mare perché pioveva molto.", "Mia sorella ha comprato una bicicletta nuova per i figli.", "Avete già visto dove sono le chiavi della macchina?", "Gli operai tornano a casa quando suona la campana."],
    "nl": ["De kat slaapt op de tafel in de keuken.", "Gisteren zijn we niet naar zee gegaan omdat het regende.", "Mijn zus heeft een nieuwe fiets voor haar kinderen gekocht.", "Heeft u gezien waar de sleutels van de auto liggen?", "De bakker om de hoek verkoopt het lekkerste brood van het dorp."],
    "sv": ["Katten sover på bordet i köket.", "Igår åkte vi inte till havet eftersom det regnade.", "Min syster har köpt en ny cykel till sina barn.", "Har ni sett var bilnycklarna ligger?", "Fiskarna kom tillbaka till hamnen med få sillar."],
    "pl": ["Kot śpi na stole w kuchni.", "Wczoraj nie pojechaliśmy nad morze, bo padało.", "Moja siostra kupiła dzieciom nowy rower.", "Czy widzieli państwo, gdzie leżą klucze do samochodu?", "Rybacy wrócili do portu z małą ilością śledzi."],
    "tr": ["Kedi mutfaktaki masanın üstünde uyuyor.", "Dün yağmur yağdığı için denize gitmedik.", "Kız kardeşim çocuklarına yeni bir bisiklet aldı.", "Arabanın anahtarlarının nerede olduğunu gördünüz mü?", "Balıkçılar limana az balıkla döndüler."],
    "ru": ["Кошка спит на столе в кухне.", "Вчера мы не поехали на море, потому что шёл дождь.", "Моя сестра купила детям новый велосипед.", "Вы не видели, где лежат ключи от машины?"],
    "fa": ["گربه روی میز آشپزخانه می‌خوابد.", "دیروز به دریا نرفتیم چون باران می‌آمد.", "خواهرم برای بچه‌ها یک دوچرخه تازه خرید.", "آیا دیده‌اید کلیدهای ماشین کجاست؟", "ماهیگیران با ماهی کمی به بندر برگشتند."],
    "el": ["Η γάτα κοιμάται πάνω στο τραπέζι της κουζίνας.", "Χθες δεν πήγαμε στη θάλασσα γιατί έβρεχε."],
}
# Openings of questions.
QUESTIONS = {
    "en": ["Could anyone tell us where we", "Does the ferry run when", "Which street leads to the place where", "Have you seen how", "Would it be all right if we", "Do you know whether", "Hi there, I was wondering if", "Where did you put"],
    "fr": ["Savez-vous où l'on", "Est-ce que le bateau part quand", "Quelle rue mène à l'endroit où", "Avez-vous vu comment", "Serait-il possible que nous", "Bonsoir, je me demandais si", "Où avez-vous mis", "Combien coûte"],
    "de": ["Wissen Sie, wo man", "Fährt die Fähre, wenn", "Welche Straße führt dorthin, wo", "Haben Sie gesehen, wie", "Wäre es in Ordnung, wenn wir", "Guten Abend, ich frage mich, ob", "Wohin haben Sie", "Wie viel kostet"],
    "es": ["¿Sabe usted dónde", "¿Sale el barco cuando", "¿Qué calle lleva al lugar donde", "¿Ha visto cómo", "¿Estaría bien que nosotros", "Buenas, me preguntaba si", "¿Dónde pusieron", "¿Cuánto cuesta"],
    "ar": ["هل تعرفون أين", "هل تبحر السفينة عندما", "أي طريق يؤدي إلى المكان حيث", "هل رأيتم كيف", "هل يناسبكم أن نقوم", "مساء الخير، كنت أتساءل", "أين وضعتم", "كم يكلف"],
}


def sentence(lang: str, rnd: random.Random) -> str:
    """A plain sentence."""
    return fill(" ".join(rnd.choice(p) for p in (PROSE if rnd.random() < 0.55 else MODAL)[lang]) + ".", lang, rnd)


def main_line(lang: str, rnd: random.Random) -> str:
    """A single-sentence paragraph: a fixed one, or a plain sentence."""
    r = rnd.random()
    return fill(rnd.choice(SINGLES[lang]), lang, rnd) if r < 0.4 else fill(rnd.choice(TALK[lang]), lang, rnd) if r < 0.5 else sentence(lang, rnd)
