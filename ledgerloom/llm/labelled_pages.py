"""Hand-labelled pages: their main text stands between BEGIN and END signs, which are no part of a page.

Written for this package, in five languages and several ways of building pages (article elements, plain div elements,
tables, forms around all), with what surrounds articles on the web.  Callers may give their own instead.
"""

BEGIN, END = "⟦", "⟧"

PAGES = (
    """<!DOCTYPE html><html><head><title>Bridge reopens</title><style>p{margin:0}</style><script>var a=1;</script></head><body>
<a class="skip-link" href="#main">Skip to content</a><div class="cookie-banner consent gdpr" role="dialog">We use cookies to improve this site. By going on you accept them. <button>Accept all</button> <a href="/privacy">Privacy notice</a></div>
<header class="site-header masthead"><a class="logo" href="/">The Valley Courier</a><nav class="main-nav navbar"><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/jobs">Jobs</a></li></ul></nav>
<form class="search-form" action="/search"><label>Search the archive</label><input name="q"><input type="submit"></form></header>
<main><nav class="breadcrumbs breadcrumb"><a href="/">Home</a> &gt; <a href="/news">Local news</a></nav>
<article>⟦<header><h1>Old bridge opens to traffic again after two years</h1><p class="byline">By Maria Kent</p></header>
<p>The stone bridge over the river carried its first cars this morning. Crews had replaced all eleven <a href="/arches">arches</a> and most of the parapet.</p>
<p>Engineers found the worst damage below the water line. <em>Nobody had looked there since the flood</em>, the county said.</p>⟧
<aside class="related"><h3>Related stories</h3><ul><li><a href="/a">Ferry stops at the end of the month</a></li><li><a href="/b">What the flood left behind</a></li></ul></aside>
⟦<h2>What comes next</h2><p>A cycle lane follows in spring. The council wants to hear from people who cross every day.</p>
<blockquote><p>We waited long enough, said the baker on the east bank.</p></blockquote>
<figure><img src="b.jpg"><figcaption>The bridge on opening day</figcaption></figure>⟧</article>
<section id="comments" class="comments"><h2>Reader comments</h2><div class="comment"><p class="comment-author">Tom says:</p><p>At last. I drove half an hour longer each day and nobody ever answered my letters about it.</p><a class="reply" href="#">Reply</a></div>
<div class="comment"><p>The old one was prettier and I doubt that this one will stand for long.</p></div><form class="comment-form respond"><label>Leave a reply</label><textarea>Your words</textarea><button>Post comment</button></form></section></main>
<aside class="sidebar"><div class="widget popular"><h3>Most read</h3><ol><li><a href="/1">Snow closes the pass</a></li><li><a href="/2">Choir wins a prize</a></li></ol></div><div class="ad advert"><p>Buy two tyres and get two more at half the price this week only.</p></div></aside>
<footer class="site-footer"><p class="copyright">&copy; 2024 The Valley Courier. All rights reserved.</p><ul><li><a href="/terms">Terms of use</a></li><li><a href="/contact">Contact us</a></li></ul></footer></body></html>""",
    """<html><head><title>Sourdough</title></head><body class="no-sidebar"><div id="wrapper"><div id="top" class="topbar"><span>Free delivery from forty euros</span> <a href="/login">Log in</a> | <a href="/cart">Basket</a></div>
<div id="header" class="banner"><a href="/">Crumb and Crust</a></div><div id="menu" class="menu"><a href="/r">Recipes</a> <a href="/t">Tools</a> <a href="/c">Classes</a></div>
<div class="newsletter subscribe signup"><h4>Join our list</h4><p>Get a recipe in your inbox every Friday. No spam and you can leave any time.</p><form><input type="email"><button>Subscribe</button></form></div>
<div id="content" class="post-content entry">⟦<h1>A sourdough that needs no kneading</h1><div>Mix flour, water, salt and the starter in the evening until no dry spot is left.</div><div>Leave it on the table over night.</div>
<ul><li>500 g of flour</li><li>350 g of water</li><li>100 g of ripe starter</li><li>10 g of salt</li></ul><div>In the morning the dough has doubled. Fold it four times, let it rest and bake it hot in a heavy pot with the lid on for half an hour.</div>⟧
<div class="ads adslot sponsored"><span>Sponsored</span><p>The only oven stone that you will ever need, now in three sizes.</p></div>⟦<p>Take the lid off for the last ten minutes. Let the loaf cool before you cut it, however hard that may be.</p>⟧
<div class="share social follow"><a href="#">Share on one network</a> <a href="#">Share on another</a> Follow us for more bread</div><div class="tags meta"><a href="/tag/bread">bread</a> <a href="/tag/slow">slow food</a></div></div>
<div id="sidebar" class="side"><h3>About me</h3><p>I have baked bread for my street since nineteen ninety nine and write about it here.</p><h3>Archive</h3><ul><li><a href="/5">May</a></li><li><a href="/6">June</a></li></ul></div>
<div id="disqus" class="discussion"><p>Anna: mine came out flat, what did I do wrong with the starter?</p><p>Joe: wait longer, it is winter and your kitchen must be cold.</p></div>
<div id="footer" class="bottom legal"><p>Crumb and Crust Ltd, registered in Cork. Prices include tax. <a href="/imprint">Imprint</a></p></div></div></body></html>""",
    """<html><body><table width="100%"><tr><td colspan="3"><font size="5">Amateur Astronomy Club</font></td></tr><tr><td class="nav"><a href="i.htm">Index</a><br><a href="m.htm">Meetings</a><br><a href="l.htm">Links</a></td>
<td>⟦<h2>Watching the double cluster</h2><p>Two clusters lie side by side between Perseus and Cassiopeia, and a pair of binoculars shows both of them at once.<p>Start from the W and go half way to the bright star in Perseus. On a dark night the naked eye sees a misty patch.
<table><tr><th>Cluster</th><th>Stars</th><th>Distance</th></tr><tr><td>West</td><td>300 or more</td><td>7,500 light years</td></tr><tr><td>East</td><td>About 240</td><td>7,600 light years</td></tr></table><p>Larger instruments lose the view of the whole.⟧</td>
<td class="rightcol promo"><b>Next meeting</b><br>First Friday of the month, eight o'clock, back room of the station. Guests are welcome.</td></tr><tr><td colspan="3" class="footer">Last changed in March. Best viewed at 800 by 600. Webmaster: <a href="mailto:x">write to me</a></td></tr></table></body></html>""",
    """<!DOCTYPE html><html lang="de"><head><title>Heizung</title></head><body><div class="hinweis notice alert" role="alert"><p>Wegen einer Störung ist unser Telefon heute nur bis zwölf Uhr besetzt.</p></div><header><p>Stadtwerke am Fluss</p><nav><ul><li><a href="/strom">Strom</a></li><li><a href="/gas">Gas</a></li><li><a href="/wasser">Wasser</a></li></ul></nav></header>
<article class="artikel">⟦<h1>Wie man die Heizung entlüftet</h1><p>Gluckert ein Heizkörper oder wird er oben nicht warm, steckt meist Luft darin. Man braucht nur einen Vierkantschlüssel und ein kleines Gefäß.</p><p>Zuerst dreht man das Ventil ganz auf und wartet eine Viertelstunde.</p><p>Danach öffnet man die Schraube an der Seite, bis Wasser kommt.</p><p>Fertig.</p>⟧</article>
<aside class="anzeige werbung"><p>Jetzt wechseln und bis zu zweihundert Euro im ersten Jahr sparen!</p></aside><div class="kommentare"><p>Karl: Bei mir kam gar kein Wasser, nur Luft, und dann war der Druck weg.</p></div>
<footer><p>&copy; Stadtwerke am Fluss &middot; <a href="/impressum">Impressum</a> &middot; <a href="/datenschutz">Datenschutz</a></p></footer></body></html>""",
    """<!DOCTYPE html><html lang="fr"><head><title>Marché</title></head><body><div id="cookies" class="popup modal overlay"><p>Nous utilisons des témoins pour mesurer notre audience et vous proposer des contenus adaptés.</p><button>Tout accepter</button></div><nav class="menu"><a href="/">Accueil</a><a href="/agenda">Agenda</a><a href="/contact">Contact</a></nav>
<main role="main"><article>⟦<h1>Le marché couvert fête ses cent ans</h1><p>Dimanche, les marchands ont ouvert une heure plus tôt que d'habitude. Une fanfare a traversé les allées avant midi.</p><p>La maire a rappelé que la halle avait failli disparaître deux fois.</p><p>Merci à tous&nbsp;!</p>⟧<div class="publicite pub"><p>Votre cuisine sur mesure en quatre semaines, devis gratuit en magasin.</p></div>
⟦<p>Une exposition de photographies reste ouverte jusqu'à la fin du mois dans l'ancienne criée.</p>⟧</article><section class="commentaires"><h3>Vos réactions</h3><p>Très belle journée, mais où était passé le vendeur de fromages de mon enfance ?</p></section></main><footer class="pied"><p>Mentions légales. Ville de la Côte, tous droits réservés.</p></footer></body></html>""",
    """<!DOCTYPE html><html lang="es"><head><title>Lluvia</title></head><body><div class="publicidad"><p>Seguro de coche desde quince euros al mes, calcula tu precio en un minuto.</p></div><header><h2>El Faro del Norte</h2><ul class="menu"><li><a href="/">Portada</a></li><li><a href="/deportes">Deportes</a></li></ul></header>
<div class="noticia story article">⟦<h1>La lluvia llena los embalses en una semana</h1><p>Los tres embalses de la comarca han ganado doce puntos desde el lunes, según los datos de la confederación.</p><p>Los agricultores esperan que el agua llegue hasta julio.</p>⟧</div>
<div class="comentarios"><p>Pepe: ojalá llueva igual en el sur, que aquí ya no queda ni barro.</p></div><div class="relacionadas recommended trending"><a href="/n1">El puerto cierra por el temporal</a><a href="/n2">Un pueblo sin luz dos noches</a></div><footer>Aviso legal. Todos los derechos reservados.</footer></body></html>""",
    """<html><head><title>Release notes</title></head><body><form id="aspnetForm" action="page.aspx"><div class="toolbar"><a href="/">Docs</a> <a href="/api">API</a> <input type="search"></div>
<div class="toc"><h4>On this page</h4><ul><li><a href="#a">Changes</a></li><li><a href="#b">Known bugs</a></li></ul></div><div class="article-body">⟦<h1>Release 4.2</h1><h2 id="a">Changes</h2><p>The parser now reads streams of any length and reports the place of an error.</p><pre>parse(stream,
      strict=True)</pre><ol><li>Install the package.</li><li>Run the <code>migrate</code> command once.</li><li>Start the service.</li></ol><h2 id="b">Known bugs</h2><dl><dt>Slow start</dt><dd>The first call fills a cache.</dd></dl>⟧</div>
<div class="pagination pager"><a href="/41">Older release</a> <a href="/43">Newer release</a></div><div class="feedback"><p>Was this page helpful? <a href="#">Yes</a> <a href="#">No</a></p></div></form></body></html>""",
    """<html><body><div class="wrap"><div class="head"><a href="/">Garden Notes</a><ul><li><a href="/v">Vegetables</a></li><li><a href="/f">Flowers</a></li></ul></div><div class="text">⟦<h2>Pruning roses in March</h2><p>Wait until the worst frost is over. Cut just above a bud that looks outwards, and take out all wood that is dead or crosses the middle.<br><br>Old shoots go first.</p><p>Feed afterwards.</p>⟧</div>
<div class="box warning"><p>This shop closes on the first of May. Please place your last orders before then.</p></div><div class="reviews"><p>Five stars, my roses have never looked better than after reading this.</p></div><div class="copyright">Garden Notes since 2003</div></div></body></html>""",
    """<!DOCTYPE html><html><body><nav><ul><li><a href="/one">one</a></li><li><a href="/two">two</a></li><li><a href="/three">three</a></li></ul></nav><!-- ad 7 --><div class="ad">Only today: nine for the price of eight.</div><article>⟦<h1>A walk along the canal</h1><p><b>The path begins behind the mill.</b><p>It is four miles long and flat, so children manage it.<p>Herons stand at the second lock.</p>⟧</article><footer>&copy; walks &middot; made with care in the north.</footer></body></html>""",
    """<!DOCTYPE html><html><body><nav><ul><li><a href="/Uno">Uno</a></li><li><a href="/dos">dos</a></li></ul></nav><div class="ad banner-ad">Gafas nuevas en una hora.</div><article>⟦<h1>Cómo elegir un melón</h1><p>Debe pesar más de lo que parece y oler un poco por la base.</p><p>Si suena hueco, está pasado.</p>⟧</article><div class="author-box bio"><p>Lola Ruiz escribe sobre fruta y verdura desde hace veinte años.</p></div><footer>Hecho en casa.</footer></body></html>""",
    """<html><body><div class="page"><div class="navigation"><a href="/">Start</a> <a href="/all">All posts</a></div><div class="post">⟦<h1 class="title">Why I stopped counting steps</h1><div class="content"><p>For three years a bracelet told me when to stand up.</p><p>Then its battery died on a Tuesday, and I walked to the lake without knowing how far it was.</p><p>I have not charged it since.</p></div>⟧<div class="post-footer"><p>Posted in habits. Twelve people liked this.</p></div></div>
<div class="responses replies"><p>Same here, mine lies in a drawer and I sleep better for it.</p></div><div class="subscribe-box"><p>Enter your address to be told about new posts by mail.</p></div></div></body></html>""",
    """<html lang="de"><body><div class="navigation"><a href="/">Startseite</a> <a href="/blog">Blog</a></div><div class="seitenleiste sidebar"><h3>Beliebt</h3><a href="/1">Zehn Suppen</a> <a href="/2">Brot ohne Hefe</a><p>Hier stellen wir jede Woche ein neues Buch aus der Region vor.</p></div><section class="beitrag">⟦<h2>Apfelmus ohne Zucker</h2><p>Die Äpfel werden geviertelt und mit wenig Wasser weich gekocht.</p><p>Süße Sorten brauchen keinen Zucker.</p><p>Heiß in Gläser füllen und sofort verschließen.</p>⟧</section><div class="newsletter"><p>Melden Sie sich an und erhalten Sie jeden Monat neue Rezepte.</p></div><div class="fuss footer">Alle Rechte vorbehalten.</div></body></html>""",
    """<html><body><div class="container"><p class="notice">This page was translated by a machine and may hold mistakes that nobody has looked at.</p><section class="main-text">⟦<h1>The lighthouse keeper's last winter</h1><p>He lit the lamp at four, as on every other day, and wrote the hour into the book.</p><p>The supply boat had not come for nine days. There was flour, there was tea, and there was enough oil for a month if the nights stayed clear.</p><p>On the tenth day he saw a sail.</p>⟧</section><div class="login-box login"><form><label>Name</label><input><label>Password</label><input><button>Log in</button></form></div><div class="disclaimer"><p>All persons in this story are made up, and the rock is too small to be on any map.</p></div></div></body></html>""",
    """<html><body><div class="c1"><ul><li><a href="/">Front page</a></li><li><a href="/w">World</a></li><li><a href="/m">Money and markets</a></li><li><a href="/s">Science</a></li></ul></div><div class="c2"><div class="x9">⟦<h1>Small towns get their own weather stations</h1><p>Forty stations will stand on school roofs by the end of the year, so that storms can be seen a few minutes earlier.</p><p>Pupils read the instruments <a href="/how">every morning</a> and send in what they find.</p><p>The data are free.</p>⟧</div><div class="x3"><ul><li><a href="/s1">Three storms in a single week</a></li><li><a href="/s2">How a rain radar sees a shower</a></li><li><a href="/s3">Why school roofs leak</a></li><li><a href="/s4">The warmest May since records began</a></li></ul></div></div><div class="c8"><a href="/t">Terms</a> <a href="/p">Privacy</a> <a href="/h">Help and contact</a></div></body></html>""",
    """<html lang="fr"><body><div><a href="/">Accueil</a> <a href="/cine">Cinéma</a> <a href="/livres">Livres</a> <a href="/expos">Expositions</a></div><div>⟦<h1>Un roman retrouvé dans une malle</h1><p>Le manuscrit compte deux cents pages, écrites au crayon dans une petite écriture serrée.</p><p>La famille veut le publier à l'automne, sans rien y changer.</p>⟧</div><div><a href="/x1">Dix livres pour l'été</a> <a href="/x2">Une librairie ferme ses portes</a> <a href="/x3">Le prix du papier monte encore</a></div><div>Haut de page</div></body></html>""",
    """<html lang="de"><body><table><tr><td><a href="/">Start</a></td><td><a href="/verein">Verein</a></td><td><a href="/termine">Termine</a></td><td><a href="/bilder">Bilder</a></td></tr></table><div>⟦<h2>Unser Ausflug an den See</h2><p>Am Samstag fuhren wir mit zwei Bussen los und waren vor der großen Hitze am Wasser.</p><p>Nach dem Essen ging es mit dem <a href="/boot">Boot</a> auf die Insel.</p><ul><li>Elf Kinder</li><li>Neun Erwachsene</li></ul>⟧</div><div><a href="/a1">Bericht vom letzten Jahr</a><br><a href="/a2">Anmeldung zum Sommerfest</a><br><a href="/a3">Protokoll der Versammlung</a></div></body></html>""",
)
