"""Labelled pages for the content model: layouts whose main text is known.

Written for this purpose. An element with the attribute ``y`` is labelled: ``y=1`` opens main text, ``y=0`` opens
something else inside it; elements without it follow their parent. ``@n`` stands for n filler words,
``#n`` for n times the same word.
"""

LAYOUTS = (
    # Semantic elements, comments below the article.
    '<html><head><title>@6</title></head><body><header class="site-header"><a href="/">@2</a><nav><ul><li><a>@1</a></li><li><a>@1</a></li><li><a>@2</a></li></ul></nav></header>'
    '<main y=1><h1>@7</h1><p>@40.</p><p>@25.</p><h2>@4</h2><p>@60.</p><ul><li>@9</li><li>@12</li></ul><blockquote>@20.</blockquote></main>'
    '<section class="comments" id="comments"><h3>@2</h3><div class="comment"><b>@2</b><p>@14.</p></div><div class="comment"><b>@1</b><p>@30.</p></div></section>'
    '<footer><p>&copy; @5</p></footer></body></html>',
    # Plain divs with telling classes.
    '<body><div id="top" class="header"><div class="logo">@2</div></div><div class="menu"><a>@1</a> <a>@2</a> <a>@1</a></div>'
    '<div id="content" class="post-content" y=1><h2>@8</h2><p>@50.</p><p>@12.</p><div class="ad" y=0>@9.</div><p>@33.</p><div class="share" y=0><a>@1</a><a>@1</a></div></div>'
    '<div class="sidebar"><h4>@2</h4><ul><li><a>@4</a></li><li><a>@5</a></li></ul></div><div id="footer">@12. <a>@2</a></div></body>',
    # Divs without classes; an aside and a form.
    '<body><div><a>@1</a><a>@1</a><a>@1</a></div><div y=1><h1>@6</h1><div>@45.</div><div>@38.</div><p>@21.</p></div>'
    '<aside><h3>@3</h3><p>@18.</p><a>@3</a></aside><form action="/s"><label>@2</label><input><button>@1</button><p>@8.</p></form><div>@4 &copy; @2</div></body>',
    # Cookie notice first, adverts around, related links last.
    '<body><div class="cookie-notice" id="consent"><p>@22. <a>@2</a></p><button>@1</button></div><nav class="breadcrumb"><a>@1</a> &gt; <a>@2</a></nav>'
    '<article y=1><header y=1><h1>@9</h1><p>@7.</p></header><p>@55.</p><aside y=0><p>@15.</p></aside><p>@28.</p><table><tr><td>@2</td><td>@3</td></tr></table><footer y=0><p>@6</p></footer></article>'
    '<div class="advert banner"><p>@11.</p></div><div class="related"><h3>@2</h3><ul><li><a>@7</a></li><li><a>@6</a></li></ul></div><footer class="footer">@15.</footer></body>',
    # Menu in the footer, a short article, unclosed paragraphs.
    '<body><nav><ul><li><a>@1</a><li><a>@1</a><li><a>@1</a></ul></nav><div class="ad">@10.</div><article y=1><h1>@8</h1><p>@30.<br><p>@16.<p>@44.</article>'
    '<footer>&copy; @1 &middot; @9. @5.</footer></body>',
    '<body><nav><ul><li><a>@1</a><li><a>@1</a></ul></nav><!-- --><div class="ad">@14. @9. @12.</div><article y=1><h1>@4</h1><p>@5.</article><footer>&copy; @1 &middot; @20. @15.</footer></body>',
    # Long comments and newsletter form.
    '<body><header><h2>@3</h2><p>@6</p></header><div class="article-body" y=1><h1>@7</h1><p>@35.</p><p>@42.</p><p>@8.</p></div>'
    '<div class="newsletter"><h4>@4</h4><p>@13.</p><form><input><button>@2</button></form></div><ol class="comment-list"><li id="comment-12"><p>@50.</p></li><li id="comment-13"><p>@24.</p><p>@17.</p></li></ol>'
    '<div class="notice warning"><p>@16.</p></div></body>',
    # Documentation page with side menu and code.
    '<body><div class="layout"><div class="side-nav"><ul><li><a>@2</a></li><li><a>@3</a><ul><li><a>@2</a></li></ul></li></ul></div><div class="main" role="main" y=1><h1>@3</h1><p>@20.</p><pre>@15</pre><h3>@4</h3><p>@31.</p>'
    '<dl><dt>@1</dt><dd>@10.</dd></dl></div></div><div class="site-footer"><ul><li><a>@1</a></li><li><a>@2</a></li></ul></div></body>',
    # News page: teaser lists and promotions before and after.
    '<body><div class="topbar notice"><p>@12. <a>@2</a></p></div><section class="story" y=1><h1>@10</h1><p>@14.</p><figure><figcaption>@9.</figcaption></figure><p>@48.</p><p>@52.</p></section>'
    '<section class="promo"><h2>@3</h2><p>@17.</p><a>@3</a></section><section class="trending"><h2>@1</h2><p><a>@8</a></p><p><a>@9</a></p></section><footer><nav><a>@1</a><a>@1</a></nav><p>@19.</p></footer></body>',
    # Forum-like reader replies and a search form above.
    '<body><form class="search"><input><select><option>@1</option><option>@2</option></select></form><div class="entry" y=1><h1>@5</h1><p>@64.</p><p>@19.</p></div>'
    '<div id="disqus_thread" class="responses"><div class="reply"><p>@21.</p></div><div class="reply"><p>@9.</p></div></div><aside class="widget"><p>@10.</p></aside></body>',
    # Nothing but text; and articles of one block without sentences.
    '<html><body><h1 y=1>@6</h1><p y=1>@40.</p><p y=1>@30.</p><p y=1>@9.</p></body></html>',
    '<body><nav><ul><li><a>@1</a><li><a>@1</a><li><a>@1</a></ul></nav><div class="ad">@10.</div><article y=1><h1>#10</h1><p>#150<br></article><footer>&copy; @1 &middot; @9. @5.</footer></body>',
    '<body><nav><ul><li><a>@1</a><li><a>@1</a></ul></nav><div class="ad">@22. @8.</div><article y=1><h1>#6</h1><p>#40<br></article><footer>&copy; @1 &middot; @20.</footer></body>',
)
