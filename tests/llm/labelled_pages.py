"""Pages in the manner of real sites, labelled by hand: (html, the article's blocks).  None was made by the generator that the field is trained on."""

PAGES = [
    # A blog: class names on body and article that say what the theme has.
    (
        """<!doctype html><html lang=en class="no-js"><head><title>Sourdough in winter – Crumb &amp; Crust</title><link rel=stylesheet href=x.css></head>
<body class="post-template-default single single-post postid-88 has-sidebar newsletter-enabled sidebar comments-open">
<a class="skip-link screen-reader-text" href="#content">Skip to content</a>
<div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">Crumb &amp; Crust</a></p><nav id="site-navigation" class="main-navigation"><ul id="primary-menu" class="menu"><li class="menu-item"><a href="/recipes">Recipes</a></li><li class="menu-item"><a href="/about">About</a></li></ul></nav></header>
<div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main">
<article id="post-88" class="post-88 post type-post status-publish hentry category-bread sidebar-left has-comments">
<header class="entry-header"><h1 class="entry-title">Sourdough in winter</h1></header>
<div class="entry-content"><p>A cold kitchen slows everything down, &amp; that isn't a bad thing.</p><p class=it's>The baker's rule: trust the dough, not the clock.</p>
<h2>What you need</h2><ul><li>500 g of strong flour</li><li>350 g of water at 30&nbsp;&deg;C</li></ul>
<blockquote><p>Time is an ingredient.</p></blockquote></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on “Sourdough in winter”</h2><ol class="comment-list"><li id="comment-1" class="comment even"><article id="div-comment-1" class="comment-body"><p>Worked for me, thank you!</p></article></li><li class="comment odd"><p>Mine came out flat.</p></li></ol>
<div id="respond" class="comment-respond"><h3>Leave a reply</h3><form id="commentform" class="comment-form"><p class="comment-notes">Your address will not be published.</p><label>Comment</label><textarea></textarea><button>Post</button></form></div></div>
</main></div><aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/a">Rye for beginners</a></li><li><a href="/b">A bakery in Lyon</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly made with butter. &copy; 2024 Crumb &amp; Crust</div></footer></div></body></html>""",
        ["Sourdough in winter", "A cold kitchen slows everything down, & that isn't a bad thing.", "The baker's rule: trust the dough, not the clock.", "What you need", "500 g of strong flour", "350 g of water at 30 °C", "Time is an ingredient."],
    ),
    # A news page of nested divs without article or main.
    (
        """<html><head><title>Harbour bridge to close for repairs</title><script>window.dataLayer=[]</script></head><body id=top class="news-page with-ads">
<div class="cookie-banner" role="dialog"><p>We use cookies to improve your experience. <a href="#">Accept all</a></p></div>
<div class="topbar"><ul class="nav-list"><li><a href="/">Home</a></li><li><a href="/local">Local</a></li><li><a href="/sport">Sport</a></li></ul></div>
<div class="wrapper"><div class="story-body"><h1>Harbour bridge to close for repairs</h1><div class="byline-text">By A. Reporter, 3 May</div>
<p>The bridge over the old harbour will close for six weeks from Monday, the city council said.</p>
<div class="ad-slot" id="ad-1"><p>Save 20% on tyres this weekend!</p></div>
<p>Engineers found cracks in two of the supports, though officials said there was "no immediate danger".</p>
<p>Buses will be sent along the coast road, which adds about fifteen minutes to most journeys.</p></div>
<div class="related-stories"><h3>Related</h3><ul><li><a href="/x">Ferry prices to rise</a></li><li><a href="/y">Council votes on budget</a></li></ul></div></div>
<div id="footer"><a href="/terms">Terms</a> <a href="/privacy">Privacy</a> <span>© 2024 The Daily Harbour</span></div></body></html>""",
        ["Harbour bridge to close for repairs", "By A. Reporter, 3 May", "The bridge over the old harbour will close for six weeks from Monday, the city council said.", "Engineers found cracks in two of the supports, though officials said there was \"no immediate danger\".", "Buses will be sent along the coast road, which adds about fifteen minutes to most journeys."],
    ),
    # A page that a server-side framework wraps into one form.
    (
        """<html><head><title>Opening hours of the museum</title></head><body><form method="post" action="./hours.aspx" id="form1"><input type="hidden" name="__VIEWSTATE" value="/wEPDwUK">
<div id="header"><a href="/">City Museum</a></div><div id="menu"><a href="/visit">Visit</a> | <a href="/tickets">Tickets</a> | <a href="/contact">Contact</a></div>
<div id="maincontent"><h1>Opening hours of the museum</h1><p>The museum is open from Tuesday to Sunday, from ten in the morning to six in the evening.</p><p>On Thursdays it stays open until nine, and entry is free after six.</p>
<table><tr><th>Day</th><th>Hours</th></tr><tr><td>Tuesday</td><td>10 to 18</td></tr></table></div>
<div id="newsletter"><label>Subscribe to our newsletter</label><input name=mail><button>Sign up</button></div>
<div id="footer">&copy; City Museum 2024, all rights reserved</div></form></body></html>""",
        ["Opening hours of the museum", "The museum is open from Tuesday to Sunday, from ten in the morning to six in the evening.", "On Thursdays it stays open until nine, and entry is free after six.", "Day", "Hours", "Tuesday", "10 to 18"],
    ),
    # Documentation with code, a formula and a details element.
    (
        """<!DOCTYPE html><html><head><title>Rate limits</title></head><body class="docs layout-sidebar-right theme-dark"><header class="navbar"><a href="/">ACME Docs</a><form role="search"><input placeholder="Search"><button>Go</button></form></header>
<nav aria-label="breadcrumb"><ol><li><a href="/docs">Docs</a></li><li>Rate limits</li></ol></nav>
<main><article><h1>Rate limits</h1><p>Every key may send a bounded number of requests a minute; energy use is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> at best.</p>
<pre><code>curl -H "Authorization: KEY" https://api.example.com/v1</code></pre><h2>When you are limited</h2><p>The server answers 429 and says in a header how long to wait.</p>
<details><summary>Why a minute?</summary><p>Shorter windows punish bursts, longer ones let them through.</p></details><p>See also <object data="x.svg">the diagram of a token bucket</object> for the rule.</p></article></main>
<aside class="toc"><p>On this page</p><ul><li><a href="#when">When you are limited</a></li></ul></aside><noscript>Please enable JavaScript to search these pages.</noscript>
<footer><p>Was this page helpful? <button>Yes</button> <button>No</button></p><p>© ACME</p></footer></body></html>""",
        ["Rate limits", "Every key may send a bounded number of requests a minute; energy use is E=mc2 at best.", 'curl -H "Authorization: KEY" https://api.example.com/v1', "When you are limited", "The server answers 429 and says in a header how long to wait.", "Why a minute?", "Shorter windows punish bursts, longer ones let them through.", "See also the diagram of a token bucket for the rule."],
    ),
    # A page laid out by tables, in the manner of the nineties.
    (
        """<HTML><HEAD><TITLE>My trip to Norway</TITLE></HEAD><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD COLSPAN=2 ID=header><A HREF=index.html>Anna's homepage</A>
<TR><TD CLASS=navbar WIDTH=150><A HREF=norway.html>Norway</A><BR><A HREF=cats.html>Cats</A><BR><A HREF=guest.html>Guestbook</A>
<TD CLASS=content><H1>My trip to Norway</H1><P>We took the night boat from Kiel and woke up among islands.<P>It rained on nine of the ten days, but the tenth was worth it all.<P>Next year we want to go to the far north.
<TR><TD COLSPAN=2 ID=footer>Copyright 1998 Anna</TABLE></BODY></HTML>""",
        ["My trip to Norway", "We took the night boat from Kiel and woke up among islands.", "It rained on nine of the ten days, but the tenth was worth it all.", "Next year we want to go to the far north."],
    ),
    # A plain article with a page-wide class of a list that names other things, in another script, with numeric references.
    (
        """<!DOCTYPE html><html lang="ja"><head><meta charset=utf-8><title>&#26412;&#12398;&#32057;&#20171;</title></head><body class='page newsletter-enabled sidebar'><nav><a href=/>ホーム</a> <a href=/list>一覧</a></nav><article><h1>&#26412;&#12398;&#32057;&#20171;</h1><p>今月は、海を旅する少年の物語を紹介します。</p><p>短い章が続き、夜に一つずつ読むのに向いています。</p><div class="share-buttons"><a href=#>共有</a></div></article><section class="comments"><h2>コメント</h2><p>とても面白かったです。</p></section><footer>&#169; 2024 図書室</footer></body></html>""",
        ["本の紹介", "今月は、海を旅する少年の物語を紹介します。", "短い章が続き、夜に一つずつ読むのに向いています。"],
    ),
]
