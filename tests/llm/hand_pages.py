"""Pages written by hand, in the words and layouts of different sites: (page, main text)."""

A = "The kiln was lit on a Tuesday and burned for nine days before anyone dared to open it."
B = "Inside stood four hundred tiles, all but seven of them whole, glazed the green of pond water."
C = "The potter's daughter kept one on her desk until she moved to the coast."
T = "Four hundred green tiles"
AB, TAB, ABC = f"{A}\n{B}", f"{T}\n{A}\n{B}", f"{A}\n{B}\n{C}"
LINKS = '<a href="/shop">Workshop</a> <a href="/visit">Opening hours</a> <a href="/map">How to find us</a>'
CLUB = "The museum has been run since 1931 by volunteers from the village, who open its doors on most weekends of the year."
PAGES = [
    (f"<body><header><a href='/'>Tile Museum</a><nav>{LINKS}</nav></header><main><h1>{T}</h1><p>{A}</p><p>{B}</p></main><footer><p>{CLUB}</p></footer></body>", TAB),
    (f"<div id='wrap'><div id='header'><p>{CLUB}</p></div><div id='content'><h2>{T}</h2><p>{A}</p><p>{B}</p></div><div id='footer'>Printed on recycled electrons.</div></div>", TAB),
    (f"<table width='100%'><tr><td colspan=2><img src=logo.gif></td></tr><tr><td width=150><a href=a.html>Glazes</a><br><a href=b.html>Clays</a><br><a href=c.html>Kilns</a></td><td><p>{A}</p><p>{B}</p></td></tr></table>", AB),
    (f"<article><h1>{T}</h1><p>{A}</p><aside><p>{CLUB}</p></aside><p>{B}</p></article>", TAB),
    (f"<article><p>{A}</p><p>{B}</p><footer><p>Ida Lund writes about craft and lives with two dogs in a former dairy.</p></footer></article>", AB),
    (f"<article><p>{A}</p><div hidden><p>{CLUB}</p></div><p>{B}</p></article>", AB),
    (f"<article><p>{A}</p><p style='display: none'>{CLUB}</p><p>{B}</p></article>", AB),
    (f"<main><article><p>{A}</p><p>{B}</p></article></main><header><p>{CLUB}</p></header>", AB),
    (f"<main><p>{A}</p><p>{B}</p></main><nav><p>{CLUB}</p></nav>", AB),
    (f"<nav aria-label='Places'>{LINKS}</nav><article><p>{A}</p><blockquote><p>{C}</p></blockquote><p>{B}</p></article>", f"{A}\n{C}\n{B}"),
    (f"<div class='post'><h1>{T}</h1><p>{A}</p><p>{B}</p></div><div id='comments'><p>My aunt had one of these in her bathroom, and we never knew what it was worth.</p></div>", TAB),
    (f"<div class='entry-content'><p>{A}</p><p>{B}</p></div><section class='comments'><ol><li><p>Lovely piece, and a lovely kiln.</p></li><li><p>Where can the tiles be seen today?</p></li></ol></section>", AB),
    (f"<div class='cookie-consent'><p>We store a small file on your device so that the map can remember where you were.</p><button>Fine</button></div><article><p>{A}</p><p>{B}</p></article>", AB),
    (f"<article><h1>{T}</h1><figure><img src=t.jpg><figcaption>{C}</figcaption></figure><p>{A}</p><p>{B}</p></article>", f"{T}\n{C}\n{A}\n{B}"),
    (f"<article><p>{A}</p><ul><li>Clay from the lower field.</li><li>Ash from the orchard.</li><li>Water from the well behind the house.</li></ul><p>{B}</p></article>", f"{A}\nClay from the lower field.\nAsh from the orchard.\nWater from the well behind the house.\n{B}"),
    (f"<article><p>{A}</p><form action='/join'><p>Hear from the museum once a month, with no more than one picture of a cat.</p><input><button>Join</button></form><p>{B}</p></article>", AB),
    (f"<body><div class='sidebar'><h3>Elsewhere on these pages</h3><p>{CLUB}</p></div><div class='content'><p>{A}</p><p>{B}</p></div></body>", AB),
    (f"<body><p>{A}</p><p>{B}</p><div class='footer'><p>{CLUB}</p></div></body>", AB),
    (f"<body><div class='ad'><p>Order your own kiln before the end of March and have it brought to your door by a man with a van.</p></div><article><p>{A}</p><p>{B}</p></article></body>", AB),
    (f"<main><h1>{T}</h1><p>{A}</p><h2>What was inside</h2><p>{B}</p><h2>Afterwards</h2><p>{C}</p></main><aside><ul><li><a href=1>Clay</a></li><li><a href=2>Ash</a></li></ul></aside>", f"{T}\n{A}\nWhat was inside\n{B}\nAfterwards\n{C}"),
    (f"<main><p>{A}<p>{B}<p>{C}</main><footer>Set in a typeface that was drawn for railway timetables.</footer>", ABC),
    (f"<div role='navigation'><p>{CLUB}</p></div><div role='main'><p>{A}</p><p>{B}</p></div>", AB),
    (f"<article><header><h1>{T}</h1></header><p>{A}</p><p>{B}</p></article><footer><nav>{LINKS}</nav><p>{CLUB}</p></footer>", TAB),
    (f"<section><h2>{T}</h2><p>{A}</p><p>{B}</p></section><div class='related-posts'><p>Also in this series: how a pond got its colour, and why the orchard burned twice.</p></div>", TAB),
    (f"<article><p>{A}</p><pre>clay   4 parts\nash    1 part</pre><p>{B}</p></article>", f"{A}\nclay 4 parts ash 1 part\n{B}"),
    (f"<article><p>{A}</p><table><tr><th>Tile</th><th>State</th></tr><tr><td>393</td><td>whole</td></tr></table><p>{B}</p></article><nav>{LINKS}</nav>", f"{A}\nTile\nState\n393\nwhole\n{B}"),
    (f"<div class='newsletter'><p>Letters go out when the kiln is lit, and at no other time.</p></div><main><p>{A}</p><p>{B}</p></main>", AB),
    (f"<dialog open><p>Before you read on, the museum would like to know which village you come from.</p></dialog><article><p>{A}</p><p>{B}</p></article>", AB),
    (f"<main><div class='breadcrumbs'>{LINKS}</div><h1>{T}</h1><p>{A}</p><p>{B}</p><div class='share-buttons'><a href=x>Send by post</a></div></main>", TAB),
    (f"<article><p>{A}</p><div class='advert'><p>{CLUB}</p></div><p>{B}</p></article><div class='legal'><p>{C}</p></div>", AB),
    (f"<html lang=en><head><title>{T}</title></head><body><div id=menu><ul><li>{LINKS.replace('</a> ', '</a><li>')}</ul></div><div id=main><p>{A}</p><p>{B}</p></div></body></html>", AB),
    (f"<article><p>{A.replace('Tuesday', '<em>Tuesday</em>')}</p><p>{B} See <a href=/c>the list</a>.</p></article><aside class='author-bio'><p>{C}</p></aside>", f"{A}\n{B} See the list."),
]
