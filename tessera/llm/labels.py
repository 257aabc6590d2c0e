"""Lines labelled by hand, on which the models of problems 1 and 5 are fitted (digits are read as 0)."""

#: Lines of menus, consent notices, counters, prompts, legal notes and footers.
PAGE_PARTS = """
Accept all
Reject optional
Reject all
Manage your privacy choices
Cookie settings
This site uses cookies. Choose which ones you accept.
By staying on this site you agree to our use of cookies and similar tools.
We and our 120 partners store small files on your device to measure visits.
Your consent is valid for 90 days on this device.
We value your privacy
Home | News | Sport | Opinion | Search | Sign in
Events  ·  Region  ·  Culture  ·  Newsletters  ·  Opinion  ·  Search  ·  Letters  ·  Jobs
Podcasts › Culture › Sport › Sign in › Business › My account › Opinion
Business > Port Ardley > Seven lessons from the silo gates
Region / Caddon » The early return of queen cages
• Latest
• Sport
• My account
• Podcasts
• Newsletters
Home
Menu
Search
Sign in
Subscribe
Archive
Letters
Topics
Weather
Region
Culture
Business
Jobs
Opinion
Events
Podcasts
Newsletters
My account
Contact
Contact us
Careers
About us
Privacy
Privacy policy
Terms of use
Site map
Back to top
Printed edition
Accessibility statement
Corrections policy
Advertise with us
Terms of use | Contact | Corrections policy
Careers | About us | Printed edition | Accessibility statement
Tap the bell to be told about new posts
Share this story with a friend
Enjoyed this? Forward it to a colleague
Got a tip? Tell the desk
Help us keep writing: leave a tip
Rate this episode and tell us what you think
Follow us for a daily round-up
Follow Harbour Post for a daily round-up
Sign up for the morning letter from Harbour Post
Leave a comment
Print this page
This page was printed from the web
Read the full story below
Jump to the comments
Scroll down for the comments
Skip to comments below
Skip to content
12 comments on “Why rain gauges matter in Caddon”
Shared 120 times since Monday
Posted 12 hours ago in North Pell
12 min read · 1,200 views · Valmorne
Tags: boxes, yards, Novo Valle
Filed under: harbour, pilots
Next: Inside the silo gates of Greyford
Previous: The slower return of battery racks
© 2020 Harbour Post. All rights reserved. No part of this page may be copied without written consent.
This material may not be published, broadcast, rewritten or redistributed in whole or part.
The views expressed are those of the writers and not of Harbour Post.
Figures in this article were correct at the time of publication and are not advice.
Registered in Larkmoor, company number 12. Published under licence 12.
Harbour Post is a member of the Caddon Press Panel; complaints within 30 days.
Alle akzeptieren
Nur notwendige
Einstellungen zur Privatsphäre
Mit der weiteren Nutzung stimmen Sie der Verwendung von Cookies zu.
Der Bote verwendet Cookies. Bitte treffen Sie eine Auswahl.
Wir und unsere 120 Partner speichern kleine Dateien auf Ihrem Gerät.
Ihre Einwilligung gilt 90 Tage auf diesem Gerät.
Kultur › Wirtschaft › Sport › Mein Konto › Leserbriefe › Aktuelles › Suche › Archiv
Meinung | Wetter | Kultur | Archiv | Wirtschaft | Mein Konto | Suche
Kultur > Saltby / Wie die Planungsstelle die Hafenkräne sieht
• Stellen
• Wetter
Startseite
Suche
Anmelden
Kultur
Wirtschaft
Leserbriefe
Termine
Aktuelles
Mein Konto
Meinung
Impressum
Datenschutz
Kontakt
Über uns
Nutzungsbedingungen
Barrierefreiheit
Abo kündigen
Abo kündigen | Nutzungsbedingungen | Über uns
Nach oben
Seite drucken
Zu den Kommentaren nach unten
Weiterlesen nach der Anzeige
Werben beim Boten
Diesen Beitrag teilen
Schreiben Sie uns Ihre Meinung
Jetzt den Morgenbrief vom Boten bestellen
Folgen Sie dem Boten für die tägliche Übersicht
Hat Ihnen der Beitrag gefallen? Empfehlen Sie ihn weiter
Unterstützen Sie unsere Arbeit mit einer Spende
79 Kommentare zu „Fünf Lehren über die Stockwaagen“
113-mal geteilt seit Dienstag
Lesezeit 36 Minuten · 400 Aufrufe · Bad Rienau
Vor 12 Stunden veröffentlicht in Caddon
Schlagwörter: Zähler, Weichen, Altmoor
Weiter: Was die Vektortabellen in Villa Encina verändern
Vorheriger Beitrag: Was die Rangsignale in Greyford verändern
© 2015 Der Bote. Alle Rechte vorbehalten. Nachdruck nur mit schriftlicher Erlaubnis.
Die Beiträge geben die Meinung der Verfasser wieder, nicht die des Boten.
Eingetragen in Torrelima, Nummer 76.
Alle Angaben ohne Gewähr, Stand zum Zeitpunkt der Veröffentlichung.
Tout accepter
Tout refuser
Gérer mes préférences
Courrier utilise des cookies. Faites votre choix.
En poursuivant votre visite, vous acceptez l'usage de traceurs.
Nous et nos 120 partenaires déposons de petits fichiers sur votre appareil.
Votre accord vaut 90 jours sur cet appareil.
Économie  ·  À la une  ·  Lettres d'info  ·  Se connecter  ·  Météo  ·  Culture
Économie > Westry / Comment l'atelier voit les balances
• Lettres d'info
• À la une
• Accueil
• Recherche
• Mon compte
Accueil
Recherche
Se connecter
Haut de page
Qui sommes-nous
Mentions légales
Confidentialité
Contact
Plan du site
Imprimer cette page
Aller aux commentaires
Descendre aux commentaires
Lire la suite plus bas
Continuer sans accepter
Suivez le Courrier chaque matin
Lire la suite ci-dessous
Donnez-nous votre avis
Abonnez-vous à la lettre du Courrier
Partager cet article
Vous avez aimé ? Faites suivre
Cela vous a plu ? Faites passer
Soutenez notre travail par un don
330 commentaires sur « Ce que les armoires changent à Oberlanz »
Partagé 12 fois depuis vendredi
Lecture 16 min · 207 vues · Westry
Publié il y a 12 heures à Caddon
Mots-clés : compteurs, quais, Altmoor
Suite : Ce que les colonies changent à Larkmoor
Article précédent : Cinq leçons sur les brûleurs
© 2015 Courrier. Tous droits réservés. Reproduction interdite sans accord écrit.
Les opinions publiées n'engagent que leurs auteurs et non le Courrier.
Les chiffres cités étaient exacts à la date de parution.
Société enregistrée à Quillan Bay sous le numéro 89.
Aceptar todo
Rechazar opcionales
Gestionar mis preferencias
El Diario utiliza cookies. Elija cuáles acepta.
Al seguir navegando acepta el uso de cookies.
Nosotros y nuestros 135 socios guardamos pequeños archivos en su equipo.
Su consentimiento vale 90 días en este equipo.
El tiempo | Buscar | Archivo | Región | Cartas | Mi cuenta | Deportes | Última hora
El tiempo > Larkmoor > Caddon y los drenajes: un balance
• Deportes
• Buscar
Inicio
Buscar
Entrar
Deportes
Cultura
Economía
Cartas
Boletines
Opinión
El tiempo
Última hora
Archivo
Región
Mi cuenta
Aviso legal
Contacto
Quiénes somos
Mapa del sitio
Volver arriba
Condiciones de uso
Volver arriba | Condiciones de uso | Aviso legal
Publicidad en el Diario
Siga leyendo más abajo
Imprimir esta página
Ir a los comentarios
Baje para ver los comentarios
Continuar sin aceptar
Siga al Diario cada mañana
Comparte esta noticia
Déjanos tu opinión
¿Te ha gustado? Pásala
Suscríbete al boletín del Diario
Apoye nuestro trabajo con una donación
37 comentarios en «Cómo ve la oficina los talleres»
Compartido 3753 veces desde el jueves
31 min de lectura · 185 visitas · Roquefeuil
Publicado hace 12 horas en Caddon
Etiquetas: contadores, muelles, Altmoor
Siguiente: Cómo ve el turno de noche los almacenes fríos
Anterior: Lo que los sinónimos cambian en Ivarsby
© 2019 El Diario. Todos los derechos reservados. Prohibida la copia sin permiso escrito.
Las opiniones son de sus autores y no del Diario.
Los datos eran correctos en la fecha de publicación.
Inscrita en Villa Encina con el número 38.
"""

#: Headings of lists of other articles.
TEASER_HEADS = """
Trending now
You may also like
Related stories
More from this section
Most read
Recommended for you
Read next
Empfohlen
Meistgelesen
Das könnte Sie auch interessieren
Mehr aus diesem Ressort
Weitere Artikel
Les plus lus
Dans la même rubrique
À lire aussi
Sur le même sujet
También le puede interesar
Más de esta sección
Noticias relacionadas
Lo más leído
"""

#: Lines of articles other than prose: bylines, dates, headings, lists, quotations, stamps, signatures, letters.
ARTICLE_LINES = """
By Anna Holm, staff writer
By Anna Holm
By the Harbour Post newsroom
Words: Anna Holm
Text: Anna Holm
Texte : Anna Holm
Texto: Anna Holm
Written by Anna Holm | 10.03.2025
Harbour Post staff report, updated 22.11.2024
From our North Pell desk
Puente Serrano, Thursday
Oberlanz, Samstag
Von Anna Holm
Von Anna Holm, 11.10.2025
Von der Redaktion Harbour Post
Aus unserem Büro in Puente Serrano
Der Bote, aktualisiert am 12.08.2025
Par Anna Holm, le 13.04.2023
Par la rédaction de Courrier
De notre bureau de Tamworthy
Courrier, mis à jour le 12.08.2025
Por Anna Holm, 10.02.2024
Por la redacción de Diario
El Diario, actualizado el 12.08.2025
Desde nuestra oficina en Caddon
Where the mite counts stand
The night shift and their firing logs
Notes on filter beds, February 2024
Winter clusters and fuse panels in Puente Serrano
Harbour Council in May 2016
## Where the pasture strips stand
## Notes on pasture strips, October 2020
Was die Nachtschicht dazu sagt
Stand der Dinge: die Spundwände
Harbour Council im Mai 2016
Rohrnetze und Zähler in Caddon
Ce qu'en dit un comité de contrôle
Où en sont les antennes
Harbour Trust en février 2022
Les colonies et les relevés de fuites à Montrevel
Lo que dice la oficina técnica
Cómo están los recuentos de ácaros
Harbour Trust en febrero de 2022
Los contadores y los mapas en Caddon
## Lo que dice el turno de noche
[00:03:35] Anna Holm: It took 123 days until the pumps were tested again.
[00:03:35] After 2012 the cold stores were rebuilt.
-- Anna Holm
— Harbour Trust
Kind regards, Anna Holm
Viele Grüße, Anna Holm
Bien à vous, Anna Holm
Un saludo, Anna Holm
My address is anna@mail.example, please reply off-list.
Tel. 404 555 0198
National ID: 958595488
Home address: 124 Old Mill Way, Caddon 93802
Contact: anna@mail.example
Please pass this on to Anna Holm before Friday.
Thanks to my neighbour Anna Holm for the photographs.
Follow @kelpwatch29 for glaze recipes.
> Most of the radar tiles were sorted late in the season.
@moss58 By January about 690 windows had been paused so that results could be compared.
- Their plan names three steps: the tide tables, the quay cranes and the audit.
- Compared with 2023, launch windows need 84 percent less attention.
- Seit 2023 werden die Sensoren alle 19 Wochen stillgelegt, um Kosten zu sparen.
- Les coûts pour les quais ont monté de 24 pour cent.
- Nadie en el taller esperaba menos esperas.
Bus 14 stops at Larch Street and Millbrook Road.
Order 4471-220-8700 was shipped in 23 boxes.
Part no. 7694-4810-348 rev. 26
Install with pkg@7.16.15 and restart.
Readers who turn off JavaScript still see the full article.
def rank(q, k=10):     return sorted(q)[:k]
"""

#: Filler text.
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Lorem ipsum dolor amet velar quonda missum. Vestib dolor terrae quonda dictum porta semperi mollisum velar nullam aliqua alunt ipsum.
Praesto praesto mollisum vestib vitaer odiom gravit massa suspen fervis felisque tellum lacin ornare varius pondera nuncat.
This is sample text. Replace it with your own paragraph.
This block is only here to fill the column.
Your content goes here. Click to edit this block.
Your text will appear here later.
Placeholder paragraph used to show the layout of the page.
Dummy copy for the new template, do not publish.
Test test test, please ignore this entry.
Sample description text for layout only.
Summary goes here
Description goes here
Nur ein Test, bitte nicht beachten.
Dies ist ein Blindtext und zeigt nur das Layout.
Hier steht später Ihr Text.
Hier steht später die Zusammenfassung.
Platzhalter für den Vorspann.
Platzhaltertext für das Layout der Seite.
Placeholder for the introduction.
Sample headline goes in this space.
Test paragraph, do not publish.
Testabsatz, nicht veröffentlichen.
Hier kommt die Überschrift hin.
Paragraphe de test, ne pas publier.
Un titre d'exemple prendra place ici.
Párrafo de prueba, no publicar.
Aquí va un titular de ejemplo.
Texte provisoire pour le chapô.
Texto provisional para la entradilla.
Beispieltext, bitte durch eigenen Inhalt ersetzen.
Ceci est un texte d'exemple à remplacer.
Votre contenu apparaîtra ici.
Faux texte pour la maquette.
Le résumé apparaîtra ici.
Ceci est un test, merci de ne pas en tenir compte.
Este es un texto de ejemplo, sustitúyalo por el suyo.
Su contenido aparecerá aquí.
Texto de relleno para la maqueta.
Aquí irá el resumen.
Esto es una prueba, no la tenga en cuenta.
Bacon ipsum dolor amet pork belly brisket tenderloin short ribs, andouille pastrami flank venison drumstick.
Cupcake ipsum dolor sit amet wafer gummies tiramisu jelly beans croissant marzipan topping.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores.
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. Vestibulum tortor quam.
Curabitur pretium tincidunt lacus, nulla gravida orci a odio. Nullam varius, turpis et commodo pharetra, est eros bibendum elit.
Mauris blandit aliquet elit, eget tincidunt nibh pulvinar a. Vivamus magna justo, lacinia eget consectetur sed, convallis at tellus.
Donec sollicitudin molestie malesuada. Proin eget tortor risus. Vivamus suscipit tortor eget felis porttitor volutpat.
Quisque velit nisi, pretium ut lacinia in, elementum id enim. Praesent sapien massa, convallis a pellentesque nec, egestas non nisi.
Integer nec odio praesent libero sed cursus ante dapibus diam. Sed nisi nulla quis sem at nibh elementum imperdiet.
Fusce nec tellus sed augue semper porta mauris massa. Class aptent taciti sociosqu ad litora torquent per conubia nostra.
Phasellus ultrices nulla quis nibh. Aenean fermentum, elit eget tincidunt condimentum, eros ipsum rutrum orci, sagittis tempus lacus enim ac dui.
Li Europan lingues es membres del sam familie. Lor separat existentie es un myth.
"""

#: Error messages and demands to allow scripts.
NOTICES = """
404 Not Found
404 - not found
Error 404: page not found
Page not found. The address is wrong or the story was removed.
Sorry, this story was removed or never existed.
HTTP 500 Internal Server Error
500 page missing or moved 12787ms
Error 500: summary service did not answer (request a5424b75a2)
HTTP 504. Request 9beace3fb5 timed out after 3000 ms.
Status: 404. the requested document could not be delivered. node-8
ERR_504: upstream closed the connection before the body was read (5d6bb05191)
502 Bad Gateway: the upstream server sent no valid answer. Ray 5d6bb05191
[410] the link you followed is broken
403 | you are not allowed to see this (99e636e6a8)
<h1>503</h1> gateway gave up waiting 9ms
429 content service overloaded, come back later /5b7346f2ac
Access denied. You do not have permission to view this page. Reference 5b7346f2ac
Too many requests from your network. Wait 12 minutes and retry. (id f97cc1bdf9)
Too many requests, try again in 31 minutes.
Service temporarily unavailable
Your session has expired. Sign in again to continue.
Error establishing a connection to the content store (host db-9, code 9).
Fatal error: call to a member function render() on null in /srv/app/views/page.php on line 99
{"error":{"code":500,"message":"resource could not be loaded","trace":"4cdbf8b11a"}}
{"status":503,"error":"service unavailable"}
Traceback (most recent call last): File "app.py", line 12
Please enable JavaScript to view this page.
Please enable JavaScript to read the summary.
You need to turn on scripts in your browser to read this site.
Your browser has scripting disabled, so the article cannot be displayed.
This app works best with JavaScript switched on; reload once you have done so.
noscript: content is loaded dynamically and cannot be shown
Loading… if nothing happens, allow scripts and cookies.
Checking your browser before opening the page. This takes about 9 seconds. Request 5b7346f2ac
Just a moment… checking your browser
Verify that you are human to continue.
404 | The page you asked for is not here. It may have been moved or renamed.
We noticed that scripts are blocked. Allow them for this site and try again.
Für diese Seite müssen Skripte im Browser erlaubt sein.
Nous avons remarqué que les scripts sont bloqués. Autorisez-les et réessayez.
Hemos notado que los scripts están bloqueados. Permítalos y vuelva a intentarlo.
We can't find that article. Try the search box or go back to the front page.
Service temporarily unavailable: the site is down for maintenance until 15:00.
Something went wrong on our side. Please try again later.
This content is not available in your region.
Wartungsarbeiten: der Dienst ist bis 15:00 nicht erreichbar.
Diesen Beitrag gibt es nicht mehr. Nutzen Sie die Suche.
Etwas ist schiefgegangen. Bitte versuchen Sie es später erneut.
Service indisponible : le site est en maintenance jusqu'à 15:00.
Cet article n'existe plus. Utilisez la recherche.
Une erreur est survenue. Veuillez réessayer plus tard.
Servicio no disponible: el sitio está en mantenimiento hasta las 15:00.
Esta noticia ya no existe. Use el buscador.
Se ha producido un error. Inténtelo más tarde.
Seite nicht gefunden. Die Adresse ist falsch oder der Beitrag wurde entfernt.
Fehler 500: Der Dienst antwortet nicht. Vorgang 5b7346f2ac
500 Das Dokument konnte nicht geliefert werden.
503 Der Dienst ist überlastet 9ms
403 Sie dürfen diesen Inhalt nicht sehen
404 Die Seite fehlt oder wurde verschoben
Zugriff verweigert. Kennung 5b7346f2ac
Zu viele Anfragen aus Ihrem Netz. Versuchen Sie es in 12 Minuten erneut.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Interner Serverfehler. Versuchen Sie es in 12 Minuten erneut.
Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.
Ohne JavaScript kann der Beitrag nicht angezeigt werden.
Ihr Browser wird geprüft. Das dauert etwa 9 Sekunden. Vorgang 5b7346f2ac
Sie müssen Skripte erlauben, um diese Seite zu lesen.
Page introuvable. L'adresse est fausse ou l'article a été retiré.
Erreur 500 : le service ne répond pas (requête 9beace3fb5)
ERR_404: la page manque ou a été déplacée
429 le service est surchargé
403 | vous n'avez pas accès à ce contenu /27a8e0ba77
Le document n'a pas pu être livré.
Accès refusé. Identifiant 831fe9699b
Trop de requêtes depuis votre réseau. Réessayez dans 12 minutes.
Votre session a expiré. Reconnectez-vous pour continuer.
Erreur interne du serveur. Réessayez dans 12 minutes.
Veuillez activer JavaScript pour voir cette page.
Sans JavaScript, l'article ne peut pas s'afficher.
Vous devez autoriser les scripts pour lire ce site.
Les scripts doivent être autorisés pour lire ce site.
Los scripts deben estar permitidos para leer este sitio.
Skripte müssen für diese Seite erlaubt sein.
Vérification de votre navigateur, environ 9 secondes. Requête 5b7346f2ac
Página no encontrada. La dirección es errónea o la noticia fue retirada.
Error 503: el servicio no responde (petición 8d02211862)
Error 500: el servicio no responde. Referencia d685f491c9
404 la página falta o se ha movido
429 el servicio está saturado
403 no tiene permiso para ver este contenido
No se pudo entregar el documento.
Acceso denegado. Identificador 831fe9699b
Demasiadas peticiones desde su red. Inténtelo en 12 minutos.
Error interno del servidor. Inténtelo en 12 minutos.
Su sesión ha caducado. Vuelva a entrar.
Active JavaScript para ver esta página.
Active JavaScript para leer el resumen.
Debe permitir los scripts para leer este sitio.
Sin JavaScript no se puede mostrar la noticia.
Comprobando su navegador, unos 9 segundos. Petición 5b7346f2ac
Warning: mysqli_connect(): (HY000/2002): Connection refused in /var/www/html/wp-includes/db.php on line 12
Warning: include(/home/site/public_html/header.php): failed to open stream: No such file or directory in /home/site/index.php on line 3
Notice: Undefined index: title in /var/www/site/page.php on line 41
Parse error: syntax error, unexpected end of file in /var/www/html/functions.php on line 210
Uncaught TypeError: Cannot read properties of null
java.lang.NullPointerException at com.example.Page.render(Page.java:88)
The requested URL was not found on this server.
The server encountered an internal error or misconfiguration and was unable to complete your request.
This site can't be reached. The connection was reset.
Database connection failed. Please contact the administrator.
Sorry, you have been blocked. You are unable to access this site.
Enable JavaScript and cookies to continue
This website requires JavaScript. Please turn it on and reload the page.
JavaScript is disabled in your browser. Please enable it to proceed.
Questa pagina richiede JavaScript. Attivalo nel browser per continuare.
Per visualizzare questo sito è necessario abilitare JavaScript.
Pagina non trovata. L'indirizzo è errato o l'articolo è stato rimosso.
Errore interno del server. Riprova più tardi.
Esta página requer JavaScript. Ative-o no navegador.
Página não encontrada. O endereço está errado.
Schakel JavaScript in om deze pagina te bekijken.
Pagina niet gevonden. Probeer het later opnieuw.
Aby zobaczyć tę stronę, włącz obsługę JavaScript.
Sidan kunde inte hittas. Aktivera JavaScript i webbläsaren.
"""

#: Unfilled fields and editing notes.
RESIDUE = """
{{ title }} {{site_name}} {{price|currency}} {{ name }} {{page.city}} {{ company }}
{title} | {site_name} {0} of {1} readers {location} {place.title}
${headline} ${publisher} ${publish_date} ${place.title}
#{headline} - #{section} #{orgUnit} #{region}
<%= doc.abstract %> <%= brand %> <%= org_name %>
{% block summary %}{% endblock %} {% partner %}
[[widget:latest-posts limit=5]] [[location]] [[siteName]]
<<PRESS_CONTACT>> <<PROJECT>> <<VENUE>>
@@LEAD_PARAGRAPH@@ @@CITY@@ %%CHAPO%% %%VORSPANN%% %FIRSTNAME% %SITE_NAME% %TOWN%
__AUTHOR_BIO__ __CITY__ $AUTHOR_ORG$ $TOWN$ $PLACE TITLE$
&lt;client&gt; &lt;siteName&gt; &lt;place.title&gt;
[INSERT PULL QUOTE HERE] [INSERT SUMMARY] [CITY], [MONTH] [YEAR] [Your Name] [Company] [BRAND] [PAGE CITY]
[HIER ZITAT EINFÜGEN] [ORT], [MONAT] [JAHR] [INSÉRER RÉSUMÉ] [VILLE], [MOIS] [ANNÉE] [INSERTAR CITA AQUÍ] [CIUDAD], [MES] de [AÑO]
[object Object], [object Object] Welcome back, undefined! NaN of null
Add a short description of your article here. Fügen Sie hier eine kurze Beschreibung ein. Ajoutez ici une courte description. Añada aquí una breve descripción.
TODO: replace this intro before publishing TODO: write summary FIXME check figures
(caption TK) (source TK) TK TBD XXX EDITOR: check spelling before publishing NOTE TO EDITOR
TODO: Einleitung ersetzen Anmerkung der Redaktion: Zahlen noch prüfen
TODO : remplacer le chapô avant publication À COMPLÉTER
TODO: sustituir la entradilla antes de publicar PENDIENTE
"""

#: Names of fields and the marks that templates put around them.
FIELDS = "agency article author author_org body brand city client company country date description doc event excerpt field first_name headline intro lead location name org org_name orgUnit page partner place place.title publisher region section siteName site_name subtitle summary teaser title town unit user venue resumen resume zusammenfassung nombre prenom nom nachname anrede vorname titulo titre titel entradilla chapo teaser verlag ort ville ciudad autor auteur fecha datum phone email address zip state number amount total currency start end time year month day week image link url code key value text content header footer category tags label question answer comment account contact customer order invoice delivery service position salutation greeting signature subject message strasse telefon betrag bestellung kunde adresse montant commande calle pedido cliente importe".split()
MARKS = ("*|%s|*", "##%s##", "{!%s}", "{$%s}", "<?= $%s ?>", "[%% %s %%]", "{#%s#}", "||%s||", "~~%s~~", "{{%s}}", "{{ %s }}", "{%% %s %%}", "{%s}", "${%s}", "#{%s}", "<%%= %s %%>", "[[%s]]", "<<%s>>", "@@%s@@", "%%%%%s%%%%", "%%%s%%", "__%s__", "$%s$", "&lt;%s&gt;", "[%s]")

#: What stands in brackets where a value should.
NOTED = "TBD|TBA|TBC|phone number|phone|email address|email|first name|last name|full name|address|job title|Vorname|Nachname|Telefonnummer|prénom|nom|téléphone|nombre|apellidos|teléfono".split("|")

#: Prose that only talks about such things.
ABOUT = """
In typesetting, lorem ipsum has long stood for text that is still to come, and a museum collects examples of it.
Ein Blindtext steht im Satz für Text, der noch fehlt; das Museum sammelt solche Beispiele.
En mise en page, un faux texte tient la place de ce qui manque encore; le musée en garde des exemples.
En maquetación, un texto de relleno ocupa el lugar de lo que aún falta; el museo guarda ejemplos.
Readers who turn off JavaScript still see the full article, because the firm renders its pages on the server.
Wer JavaScript abschaltet, sieht den Beitrag trotzdem, denn die Firma liefert fertige Seiten aus.
Qui coupe JavaScript voit tout de même l'article, car les pages sont produites sur le serveur.
Quien desactiva JavaScript ve igualmente la noticia, porque las páginas se generan en el servidor.
The error 404 page of the institute gets 1,324 visits a week, which the team took as a reason to repair old links.
Die Fehlerseite 404 des Instituts wird 1324-mal in der Woche aufgerufen, weshalb das Team alte Verweise repariert.
La page d'erreur 404 de l'institut reçoit 1324 visites par semaine, ce qui a poussé l'équipe à réparer les liens.
La página de error 404 del instituto recibe 1324 visitas por semana, y por eso el equipo repara enlaces.
A template such as a greeting with a name is only filled when the mail job runs, the manual explains.
"""


def fields() -> list[str]:
    """Every field in every kind of marks, in the middle of a sentence."""
    return [m % f for f in FIELDS for m in MARKS] + [f"[{x}]" for x in NOTED]


def lines(block: str) -> list[str]:
    return [x for x in block.strip("\n").split("\n") if x.strip()]
