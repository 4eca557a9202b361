"""One page per accessibility rule, and a clean page."""

from codegrain.operators import wcag

BAD = {
    "wcag-keyboard-accessible": '<div onclick="x">go</div>',
    "wcag-accessible-name": '<div onclick="x" onkeydown="y" role="tab">go</div>',
    "wcag-valid-aria-reference": '<p aria-labelledby="gone">x</p>',
    "wcag-no-positive-tabindex": '<p tabindex="3">x</p>',
    "wcag-button-has-text": '<button data-icon="x"></button>',
    "wcag-form-label": '<label for="a">A</label><input id="b">',
    "wcag-heading-order": "<h1>a</h1><h2>b</h2><h4>c</h4>",
    "wcag-semantic-elements": '<div role="navigation">x</div>',
    "wcag-aria-hidden-focus": '<button aria-hidden="true">x</button>',
    "wcag-list-structure": "<li>x</li><ul><li>y</li></ul>",
    "wcag-image-alt": '<img src="x">',
    "wcag-link-name": '<a href="/x"></a>',
    "wcag-table-headers": '<th scope="col">a</th><th>b</th>',
}
CLEAN = '<h1>a</h1><h2>b</h2><label for="q">Q</label><input id="q"><img alt="" src="x"><a href="/">home</a><ul><li>x</li></ul><button>ok</button><th>one</th>'


def test_each_rule(spark):
    rows = list(BAD.items()) + [("clean", CLEAN), ("none", None), ("empty", "")]
    got = wcag.violations(wcag.elements(spark.createDataFrame(rows, "page_id string, html string"))).collect()
    assert sorted((r["page_id"], r["rule_id"]) for r in got) == sorted((k, k) for k in BAD)


def test_all_rules_are_known():
    assert [r[0] for r in wcag.RULES] == list(BAD)
