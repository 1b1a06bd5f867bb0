"""Cart state, pricing, validation and checkout (K1-K4)."""

import random
import re
from decimal import Decimal as D

from conftest import rows

from vitrine.operators import cart as K


def loop_cart(events):
    """Reference cart semantics over (seq, user, artifact, kind, qty text)."""
    carts = {}
    for seq, user, art, kind, qty in sorted(events):
        cart = carts.setdefault(user, {})
        if kind == "checkout":
            cart.clear()
            continue
        digits = re.fullmatch(r" *[+-]?[0-9]+ *", qty or "")
        if not digits or not -2 ** 31 <= int(qty) < 2 ** 31:
            continue
        q = int(qty)
        if kind == "add":
            cart[art] = cart.get(art, 0) + max(1, q)
        elif q <= 0:
            cart.pop(art, None)
        else:
            cart[art] = q
    return {(u, a): q for u, c in carts.items() for a, q in c.items()}


def test_cart_random_against_loop(spark):
    rnd = random.Random(3)
    events = []
    for seq in range(4000):
        kind = rnd.choice(["add", "add", "set", "checkout"]) if rnd.random() > 0.02 else "checkout"
        qty = rnd.choice(["1", "2", " 3 ", "0", "-1", "x", "", "5", "+4", "1_0", "2147483647", "99999999999"])
        user = 0 if rnd.random() < 0.3 else rnd.randrange(25)  # a hot user
        events.append((seq, user, rnd.randrange(8), kind, qty))
    df = spark.createDataFrame(events, "seq long, user_id long, artifact_id long, kind string, qty string")
    got = {(u, a): q for u, a, q in rows(K.cart_state(df, ["seq"]))}
    assert got == loop_cart(events)


def test_price_validate_post(spark, tiny):
    cart = spark.createDataFrame([(3, 1, 2), (3, 5, 1), (4, 4, 2), (4, 77, 1), (5, 1, 0)],
                                 "user_id long, artifact_id long, qty int")
    priced = sorted(rows(K.price_cart(cart, tiny.artifact), "user_id", "artifact_id", "subtotal", "cart_total"))
    assert priced[:2] == [(3, 1, D("5000.00"), D("6200.00")), (3, 5, D("1200.00"), D("6200.00"))]
    assert (4, 77) not in [(u, a) for u, a, _, _ in priced]

    problems = sorted(rows(K.validate_checkout(cart, tiny.artifact), "user_id", "artifact_id", "problem", "message"))
    assert problems == [
        (4, 4, K.SHORT, "“Salt Column” has only 1 left (you requested 2)."),
        (4, 77, K.MISSING, "Artifact ID 77 no longer exists."),
    ]
    status = {u: ok for u, ok in rows(K.checkout_status(cart, tiny.artifact), "user_id", "ok")}
    assert status == {3: True, 4: False}

    posted, stock = K.post_checkout(cart, tiny.artifact, users=tiny.users)
    got = sorted(rows(posted, "customer_id", "artifact_id", "quantity", "total_amount", "payment_method"))
    assert got == [(3, 1, 2, D("5000.00"), "Card"), (3, 5, 1, D("1200.00"), "Card")]
    assert dict(rows(stock, "artifact_id", "quantity")) == {1: 7, 2: 3, 3: 1, 4: 1, 5: 7}


def test_competing_carts_settle_in_order(spark, tiny):
    # Two carts each want the last Iron Heron: the first in cart order wins.
    cart = spark.createDataFrame([(3, 3, 1), (4, 3, 1)], "user_id long, artifact_id long, qty int")
    posted, stock = K.post_checkout(cart, tiny.artifact, users=tiny.users)
    assert rows(posted, "customer_id") == [(3,)]
    assert dict(rows(stock, "artifact_id", "quantity"))[3] == 0


def loop_checkout(carts, stock, known):
    """Carts one after the other, each as a whole."""
    first = dict(stock)
    posted = []
    for user in sorted(carts):
        lines = carts[user]
        if user not in known or any(a not in stock or q > first[a] for a, q in lines.items()):
            continue
        if all(q <= stock[a] for a, q in lines.items()):
            for a, q in lines.items():
                stock[a] -= q
                posted.append((user, a, q))
    return sorted(posted)


def test_a_cart_that_loses_one_line_posts_nothing(spark, tiny):
    cart = spark.createDataFrame([(3, 3, 1), (4, 3, 1), (4, 5, 2), (5, 5, 7)], "user_id long, artifact_id long, qty long")
    posted, stock = K.post_checkout(cart, tiny.artifact, users=tiny.users)
    assert sorted(rows(posted, "customer_id", "artifact_id", "quantity")) == [(3, 3, 1), (5, 5, 7)]
    assert dict(rows(stock, "artifact_id", "quantity"))[5] == 1


def test_competing_carts_against_a_loop(spark):
    rnd = random.Random(8)
    stock = {a: rnd.choice([1, 2, 3, 8, 20]) for a in range(12)}
    carts = {u: {(0 if rnd.random() < 0.35 else rnd.randrange(13)): rnd.randint(1, 4) for _ in range(rnd.randint(1, 4))} for u in range(120)}
    known = set(range(110))
    cart = spark.createDataFrame([(u, a, q) for u, c in carts.items() for a, q in c.items()], "user_id long, artifact_id long, qty long")
    artifact = spark.createDataFrame([(a, "t", D("2.50"), q) for a, q in stock.items()], "artifact_id long, title string, price decimal(12,2), quantity int")
    users = spark.createDataFrame([(u,) for u in known], "user_id long")
    posted, after = K.post_checkout(cart, artifact, users=users)
    want = loop_checkout(carts, stock, known)
    assert sorted(rows(posted, "customer_id", "artifact_id", "quantity")) == want
    assert dict(rows(after, "artifact_id", "quantity")) == stock


def test_huge_quantities_do_not_fail_the_cart(spark, tiny):
    df = spark.createDataFrame([(i, 1, 1, "add", "2147483647") for i in range(3)], "seq long, user_id long, artifact_id long, kind string, qty string")
    cart = K.cart_state(df, ["seq"])
    assert rows(cart) == [(1, 1, 3 * 2147483647)]
    assert rows(K.price_cart(cart, tiny.artifact), "subtotal") == [(D("16106127352500.00"),)]
    assert rows(K.validate_checkout(cart, tiny.artifact), "problem") == [(K.SHORT,)]


def test_a_chain_of_carts_settles_in_one_fold(spark):
    """Cart k shares one artifact with the cart before it and one with the cart
    after: cart 0 passes, 1 does not, 2 does, and so on.  The jobs are as many for
    1,000 carts as for 10."""
    jobs = []
    for n in (10, 1000):
        cart = spark.createDataFrame([(u, a, 1) for u in range(n) for a in (u, u + 1)], "user_id long, artifact_id long, qty long")
        lines = cart.selectExpr("*", "1 AS stock")
        spark.sparkContext.setJobGroup(f"chain{n}", "")
        settled = dict(rows(K.settle_carts(lines), "user_id", "accepted"))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain{n}")))
        assert settled == {u: u % 2 == 0 for u in range(n)}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[0] - jobs[1]) <= 2


def test_settling_does_not_depend_on_how_links_are_joined_up(spark, monkeypatch):
    from vitrine.functions import grouping

    cart = spark.createDataFrame([(u, a, 1) for u in range(60) for a in (u, u + 1)], "user_id long, artifact_id long, qty long")
    monkeypatch.setattr(K, "connected", lambda links: grouping.connected(links, few_links=5))
    settled = dict(rows(K.settle_carts(cart.selectExpr("*", "1 AS stock")), "user_id", "accepted"))
    assert settled == {u: u % 2 == 0 for u in range(60)}


def loop_checkouts(events, stock, known):
    """The whole log, one event after the other, over (seq, user, artifact, kind, qty text)."""
    carts, left, sales, problems = {}, dict(stock), [], []
    for seq, user, art, kind, qty in sorted(events):
        cart = carts.setdefault(user, {})
        if kind == "checkout":
            bad = [(seq, user, a, q, left.get(a), K.SHORT if a in left else K.MISSING) for a, q in cart.items() if a not in left or q > left[a]]
            if not bad and cart and user not in known:
                bad = [(seq, user, None, None, None, K.UNKNOWN_USER)]
            problems += bad
            if not bad:
                for a, q in cart.items():
                    left[a] -= q
                    sales.append((seq, user, a, q))
                carts[user] = {}
        elif re.fullmatch(r" *[+-]?[0-9]+ *", qty or "") and -2 ** 31 <= int(qty) < 2 ** 31:
            q = int(qty)
            if kind == "add":
                cart[art] = cart.get(art, 0) + max(1, q)
            elif q > 0:
                cart[art] = q
            else:
                cart.pop(art, None)
    return sorted(sales), sorted(problems, key=str), {(u, a): q for u, c in carts.items() for a, q in c.items()}, left


def test_checkouts_in_a_log_against_a_loop(spark):
    rnd = random.Random(21)
    stock = {a: rnd.choice([0, 1, 3, 8, 30, 500]) for a in range(16)}
    events = []
    for seq in range(2500):
        user = 0 if rnd.random() < 0.2 else rnd.randrange(40)
        kind = rnd.choice(["add", "add", "set", "checkout"]) if user % 7 else rnd.choice(["add", "set"])  # every seventh never checks out
        art = rnd.randrange(17) if rnd.random() < 0.3 else user % 17
        events.append((seq, user, art, kind, rnd.choice(["1", "2", " 3 ", "0", "-1", "x", None, "+4", "2147483647"] if rnd.random() < 0.1 else ["1", "2"])))
    df = spark.createDataFrame(events, "seq long, user_id long, artifact_id long, kind string, qty string")
    artifact = spark.createDataFrame([(a, f"t{a}", D("2.50"), q) for a, q in stock.items()], "artifact_id long, title string, price decimal(12,2), quantity int")
    users = spark.createDataFrame([(u,) for u in range(36)], "user_id long")
    got = K.play_checkouts(df, artifact, ["seq"], users=users)
    sales, problems, carts, left = loop_checkouts(events, stock, set(range(36)))
    assert sorted(rows(got.purchases, "seq", "customer_id", "artifact_id", "quantity")) == sales
    assert sorted(rows(got.refusals, "seq", "user_id", "artifact_id", "qty", "stock", "problem"), key=str) == problems
    assert {(u, a): q for u, a, q in rows(got.carts)} == carts
    assert dict(rows(got.artifact, "artifact_id", "quantity")) == left
    assert len(sales) > 30 and len(problems) > 100 and {p[-1] for p in problems} == {K.SHORT, K.MISSING, K.UNKNOWN_USER}


def test_a_refused_checkout_keeps_its_cart(spark):
    events = [(1, 1, 7, "add", "2"), (2, 2, 7, "add", "1"), (3, 2, None, "checkout", None), (4, 1, None, "checkout", None),
              (5, 1, 7, "set", "1"), (6, 1, None, "checkout", None), (7, 1, None, "checkout", None)]
    df = spark.createDataFrame(events, "seq long, user_id long, artifact_id long, kind string, qty string")
    artifact = spark.createDataFrame([(7, "Iron Heron", D("10.00"), 2)], "artifact_id long, title string, price decimal(12,2), quantity int")
    got = K.play_checkouts(df, artifact, ["seq"])
    assert sorted(rows(got.purchases)) == [(3, 2, 7, 1, D("10.00"), "Card"), (6, 1, 7, 1, D("10.00"), "Card")]
    assert rows(got.refusals) == [(4, 1, 7, 2, 1, K.SHORT, "“Iron Heron” has only 1 left (you requested 2).")]
    assert rows(got.carts) == [] and rows(got.artifact, "quantity") == [(0,)]
    empty = K.play_checkouts(df.limit(0), artifact, ["seq"])
    assert [d.count() for d in empty] == [0, 0, 0, 1]
