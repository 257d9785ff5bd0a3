"""Hand-written pages of layouts that the generator of the training pages doesn't know, with their main texts."""

PAGES = {
    "encyclopedia": (
        """<!DOCTYPE html><html class="client-nojs"><head><title>Ada Winter - Open Encyclopedia</title><script>for(i=0;i<links.length;i++){if(i<n)mark(i)}</script></head>
<body class="mediawiki ltr"><div id="mw-navigation"><h2>Navigation menu</h2><div id="p-personal"><ul><li><a href="/w/Login">Log in</a></li><li><a href="/w/Talk">Talk</a></li></ul></div></div>
<div id="content" class="mw-body" role="main"><h1 id="firstHeading">Ada Winter</h1><div id="bodyContent"><div id="mw-content-text"><div class="mw-parser-output">
<p><b>Ada Winter</b> (1815 &ndash; 1852) was a mathematician who is known for her work on early <a href="/wiki/Computer">computing machines</a>.</p>
<h2>Life</h2><p>She was born in the north of the country, where her father kept a small school for the children of the village.</p>
<p>In 1833 she met the inventor, and they wrote letters to each other for many years afterwards.</p></div></div></div></div>
<div id="footer" role="contentinfo"><ul><li>This page was last edited on 3 May 2021.</li><li><a href="/privacy">Privacy policy</a></li></ul></div></body></html>""",
        ["Ada Winter", "Ada Winter (1815 – 1852) was a mathematician who is known for her work on early computing machines.", "Life", "She was born in the north of the country, where her father kept a small school for the children of the village.", "In 1833 she met the inventor, and they wrote letters to each other for many years afterwards."],
    ),
    "tables": (
        """<HTML><BODY bgcolor="#ffffff"><TABLE width="100%"><TR><TD colspan=2><FONT size="+2">Riverside Garden Club</FONT></TD></TR>
<TR><TD width=150 valign=top class="menu"><A HREF="index.htm">Home</A><BR><A HREF="roses.htm">Roses</A><BR><A HREF="links.htm">Links</A></TD>
<TD valign=top class="content"><H1>Pruning roses in spring</H1><P>Wait until the last hard frost has passed, then cut out all dead wood with a clean, sharp blade.
<P>Cut just above a bud that faces outwards, so that the middle of the bush stays open to light and air.</TD></TR>
<TR><TD colspan=2 class="footer">Copyright 1999 Riverside Garden Club</TD></TR></TABLE></BODY></HTML>""",
        ["Pruning roses in spring", "Wait until the last hard frost has passed, then cut out all dead wood with a clean, sharp blade.", "Cut just above a bud that faces outwards, so that the middle of the bush stays open to light and air."],
    ),
    "news": (
        """<html lang="en"><body><a class="skip" href="#main">Skip to content</a><header class="site-header"><div class="logo"><a href="/">The Daily Harbour</a></div><nav aria-label="Primary"><a href="/uk">UK</a><a href="/world">World</a><a href="/sport">Sport</a></nav></header>
<main id="main"><article class="story"><header><h1>Ferry returns to service after storm</h1></header><div class="story-body">
<p>The island ferry sailed again on Tuesday morning, four days after the storm damaged the pier.</p><aside class="ad-slot"><span>Advertisement</span></aside>
<p>&ldquo;We are glad to be moving again,&rdquo; said the captain, who has worked on the route for twenty years.</p>
<p>Engineers will look at the pier once more in April, when the weather allows divers to go down.</p></div></article></main>
<section class="related"><h2>More stories</h2><ul><li><a href="/1">Council votes on new road</a></li><li><a href="/2">Schools open late</a></li></ul></section>
<footer class="site-footer"><p>&copy; 2023 Harbour Media Ltd</p></footer></body></html>""",
        ["Ferry returns to service after storm", "The island ferry sailed again on Tuesday morning, four days after the storm damaged the pier.", "“We are glad to be moving again,” said the captain, who has worked on the route for twenty years.", "Engineers will look at the pier once more in April, when the weather allows divers to go down."],
    ),
    "blog": (
        """<html><body class="home blog"><div id="page"><div id="masthead"><p class="site-title"><a href="/">Notes from a small kitchen</a></p></div>
<div id="primary"><div class="post hentry"><h2 class="entry-title">Bread without kneading</h2><div class="entry-content"><p>Mix flour, water, salt and a little yeast, cover the bowl, and leave it on the table overnight.</p>
<p>The next day, fold the dough twice and bake it in a hot iron pot until the crust is dark.</p><ul><li>Three cups of flour</li><li>One and a half cups of water</li></ul></div></div>
<div id="comments"><h3>2 responses</h3><ol class="commentlist"><li class="comment"><p>I tried this on Sunday and it was lovely, thank you!</p></li><li class="comment"><p>Mine did not rise. What could be wrong?</p></li></ol></div></div>
<div id="secondary" class="widget-area"><h3>Archives</h3><ul><li><a href="/2020">2020</a></li><li><a href="/2019">2019</a></li></ul></div><div id="colophon">Proudly served with butter</div></div></body></html>""",
        ["Bread without kneading", "Mix flour, water, salt and a little yeast, cover the bowl, and leave it on the table overnight.", "The next day, fold the dough twice and bake it in a hot iron pot until the crust is dark.", "Three cups of flour", "One and a half cups of water"],
    ),
    "documentation": (
        """<html><body><div class="navbar"><a href="/">toolbox</a> <a href="/api">API</a> <a href="/faq">FAQ</a></div><div class="layout"><div class="sidebar toc"><ul><li><a href="#install">Install</a></li><li><a href="#use">Use</a></li></ul></div>
<div class="main content"><section><h1>Install the tool</h1><p>Download the archive for your system, unpack it, and put the program in a folder on your path.</p><pre>tar xf toolbox.tar
cp toolbox /usr/local/bin</pre><p>To see whether it works, ask for the version, which is printed on one line.</p></section></div></div><div class="footer">Built with care. <a href="/license">License</a></div></body></html>""",
        ["Install the tool", "Download the archive for your system, unpack it, and put the program in a folder on your path.", "tar xf toolbox.tar cp toolbox /usr/local/bin", "To see whether it works, ask for the version, which is printed on one line."],
    ),
    "plain": (
        """<html><body><h1>A letter from the coast</h1><p>The wind has been from the west all week, and nobody has gone out to fish since Monday.<p>We mend the nets, drink tea, and wait for the sea to settle down again.<p>Write soon, and tell us how the city looks in the snow.</body></html>""",
        ["A letter from the coast", "The wind has been from the west all week, and nobody has gone out to fish since Monday.", "We mend the nets, drink tea, and wait for the sea to settle down again.", "Write soon, and tell us how the city looks in the snow."],
    ),
    "german": (
        """<html lang="de"><body><div id="kopf" class="header"><a href="/">Stadtblatt</a></div><div class="navigation"><ul><li><a href="/lokal">Lokales</a></li><li><a href="/kultur">Kultur</a></li></ul></div><div class="artikel article-text"><h1>Neue Brücke über den Fluss</h1><p>Die Stadt hat am Freitag die neue Brücke eröffnet, die beide Ufer für Fußgänger und Radfahrer verbindet.</p><p>Der Bau dauerte drei Jahre und kostete weniger, als der Rat zu Beginn befürchtet hatte.</p></div><div class="werbung ad">Jetzt Abo sichern!</div><div class="footer">Impressum | Datenschutz</div></body></html>""",
        ["Neue Brücke über den Fluss", "Die Stadt hat am Freitag die neue Brücke eröffnet, die beide Ufer für Fußgänger und Radfahrer verbindet.", "Der Bau dauerte drei Jahre und kostete weniger, als der Rat zu Beginn befürchtet hatte."],
    ),
    "deep": (
        "<html><body>" + "<div>" * 14 + """<div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept</button></div>""" + """<div class="post-body"><h1>Walking the old railway</h1><p>The rails are gone, but the cutting through the hill still keeps its even slope.</p><p>Take the path by the mill, cross the stream, and follow the wall until you see the tunnel.</p></div>""" + "</div>" * 14 + """<div class="social share"><a href="#">Tweet</a><a href="#">Mail</a></div></body></html>""",
        ["Walking the old railway", "The rails are gone, but the cutting through the hill still keeps its even slope.", "Take the path by the mill, cross the stream, and follow the wall until you see the tunnel."],
    ),
    "scripts": (
        """<html><head><script>if (a<b && c>d) document.write("<div class='x'>no</div>");</script><style>p > a {}</style></head><body><nav><a href="/">Start</a></nav><article><h1>How tides work</h1><p>The moon pulls on the sea, and where x < y the water rises twice a day.</p><script>for(var i=0;i<n;i++){a(i)}</script><p>After the script the text goes on, as it should, to its proper end.</p></article><script>while(k<9)k++</script><footer>Imprint</footer></body></html>""",
        ["How tides work", "The moon pulls on the sea, and where x < y the water rises twice a day.", "After the script the text goes on, as it should, to its proper end."],
    ),
    "forms": (
        """<html><body><div class="topbar"><form action="/s"><label>Search</label><input name=q><button>Go</button></form></div><div role="navigation"><ul><li><a href="/a">Guides</a></li><li><a href="/b">Prices</a></li></ul></div><div id="main-content"><h1>Choosing a tent</h1><p>Think first about where you will sleep, since a heavy tent is no use on a long walk.</p><blockquote>A good tent is one that you can put up in the dark.</blockquote><p>Then count the people, add one for the bags, and look at what remains of your money.</p></div><div class="newsletter"><p>Subscribe to our newsletter.</p><form><input name=mail><button>Join</button></form></div></body></html>""",
        ["Choosing a tent", "Think first about where you will sleep, since a heavy tent is no use on a long walk.", "A good tent is one that you can put up in the dark.", "Then count the people, add one for the bags, and look at what remains of your money."],
    ),
}
