"""Mask rules for log messages.

The rules run in list order and each one sees the text the earlier ones left.
"""

from __future__ import annotations

# One rule per line, mask name, a tab, then the regular expression.
RULE_TEXT = r'''
ERROR_FULL_ADS_TIMEOUT	"error":"failed to get ads: rpc error: code = DeadlineExceeded desc = context deadline exceeded"
ERROR_FULL_ADS_UNKNOWN_EMPTY	"error":"failed to get ads: rpc error: code = Unknown desc = "
ERROR_FULL_CART_RETRIEVE_CANCELED	"error":"could not retrieve cart: rpc error: code = Canceled desc = context canceled"
ERROR_FULL_CART_RETRIEVE_CLOSING	"error":"could not retrieve cart: rpc error: code = Unavailable desc = transport is closing"
ERROR_FULL_CART_RETRIEVE_FAILED_PRECONDITION	"error":"could not retrieve cart: rpc error: code = FailedPrecondition desc = Can't access cart storage
ERROR_ADS_TIMEOUT_GET_ROOT	"error":"failed to get ads: rpc error: code = DeadlineExceeded[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/"
ERROR_ADS_UNKNOWN_GET_ROOT	"error":"failed to get ads: rpc error: code = Unknown[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/"
ERROR_ADS_TIMEOUT_GET_PRODUCT	"error":"failed to get ads: rpc error: code = DeadlineExceeded[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/product/
ERROR_ADS_UNKNOWN_GET_PRODUCT	"error":"failed to get ads: rpc error: code = Unknown[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/product/
ERROR_CART_RETRIEVE_CANCELED_GET_CART	"error":"could not retrieve cart: rpc error: code = Canceled[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/cart"
ERROR_CART_RETRIEVE_UNAVAILABLE_GET_CART	"error":"could not retrieve cart: rpc error: code = Unavailable[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/cart"
ERROR_CART_RETRIEVE_FAILED_PRECONDITION_GET_CART	"error":"could not retrieve cart: rpc error: code = FailedPrecondition[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/cart"
ERROR_CART_RETRIEVE_CANCELED_GET_ROOT	"error":"could not retrieve cart: rpc error: code = Canceled[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/"
ERROR_CART_RETRIEVE_UNAVAILABLE_GET_ROOT	"error":"could not retrieve cart: rpc error: code = Unavailable[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/"
ERROR_CART_RETRIEVE_GET_CART	"error":"could not retrieve cart:[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/cart"
ERROR_CART_RETRIEVE_GET_ROOT	"error":"could not retrieve cart:[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/"
ERROR_CART_ADD_POST_CART	"error":"failed to add to cart:[^"]+","http.req.id":"[^"]+","http.req.method":"POST","http.req.path":"/cart"
ERROR_RECOMMENDATION_GET_CART	"error":"failed to get product recommendations:[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/cart"
ERROR_SHIPPING_GET_CART	"error":"failed to get shipping quote:[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/cart"
ERROR_ADS_GET_ROOT	"error":"failed to get ads:[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/"
ERROR_ADS_GET_PRODUCT	"error":"failed to get ads:[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/product/[^"]+"
ERROR_PRODUCT_GET_PRODUCT	"error":"could not retrieve product:[^"]+","http.req.id":"[^"]+","http.req.method":"GET","http.req.path":"/product/[^"]+"
ERROR_PRODUCT_POST_CART	"error":"could not retrieve product:[^"]+","http.req.id":"[^"]+","http.req.method":"POST","http.req.path":"/cart"
ERROR_ORDER_POST_CHECKOUT	"error":"failed to complete the order:[^"]+","http.req.id":"[^"]+","http.req.method":"POST","http.req.path":"/cart/checkout"
ERROR_CART_RETRIEVE_UNAVAILABLE	"error":"could not retrieve cart:[^"]+code = Unavailable[^"]+"
ERROR_CART_RETRIEVE_CANCELED	"error":"could not retrieve cart:[^"]+code = Canceled[^"]+"
ERROR_CART_RETRIEVE_TIMEOUT	"error":"could not retrieve cart:[^"]+code = DeadlineExceeded[^"]+"
ERROR_CART_RETRIEVE_FAILED_PRECONDITION	"error":"could not retrieve cart:[^"]+code = FailedPrecondition[^"]+"
ERROR_CART_ADD_UNAVAILABLE	"error":"failed to add to cart:[^"]+code = Unavailable[^"]+"
ERROR_CART_ADD_CANCELED	"error":"failed to add to cart:[^"]+code = Canceled[^"]+"
ERROR_CART_ADD_TIMEOUT	"error":"failed to add to cart:[^"]+code = DeadlineExceeded[^"]+"
ERROR_PRODUCT_RETRIEVE_UNAVAILABLE	"error":"could not retrieve product:[^"]+code = Unavailable[^"]+"
ERROR_PRODUCT_RETRIEVE_CANCELED	"error":"could not retrieve product:[^"]+code = Canceled[^"]+"
ERROR_RECOMMENDATION_UNAVAILABLE	"error":"failed to get product recommendations:[^"]+code = Unavailable[^"]+"
ERROR_RECOMMENDATION_CANCELED	"error":"failed to get product recommendations:[^"]+code = Canceled[^"]+"
ERROR_SHIPPING_QUOTE_UNAVAILABLE	"error":"failed to get shipping quote:[^"]+code = Unavailable[^"]+"
ERROR_SHIPPING_QUOTE_CANCELED	"error":"failed to get shipping quote:[^"]+code = Canceled[^"]+"
ERROR_ORDER_COMPLETE_UNAVAILABLE	"error":"failed to complete the order:[^"]+code = Unavailable[^"]+"
ERROR_ORDER_COMPLETE_CANCELED	"error":"failed to complete the order:[^"]+code = Canceled[^"]+"
ERROR_ADS_GET_UNAVAILABLE	"error":"failed to get ads:[^"]+code = Unavailable[^"]+"
ERROR_ADS_GET_TIMEOUT	"error":"failed to get ads:[^"]+code = DeadlineExceeded[^"]+"
ERROR_ADS_GET_UNKNOWN	"error":"failed to get ads:[^"]+code = Unknown[^"]+"
ERROR_ADS_RETRIEVE_UNKNOWN	"error":"failed to retrieve ads:[^"]+code = Unknown[^"]+"
ERROR_CART_RETRIEVE_CONNECTION_REFUSED	"error":"could not retrieve cart:[^"]+connection refused[^"]+"
ERROR_CART_RETRIEVE_TRANSPORT_CLOSING	"error":"could not retrieve cart:[^"]+transport is closing[^"]+"
ERROR_CART_RETRIEVE_CONTEXT_CANCELED	"error":"could not retrieve cart:[^"]+context canceled[^"]+"
ERROR_CART_ADD_CONNECTION_REFUSED	"error":"failed to add to cart:[^"]+connection refused[^"]+"
ERROR_CART_ADD_TRANSPORT_CLOSING	"error":"failed to add to cart:[^"]+transport is closing[^"]+"
ERROR_CART_ADD_CONTEXT_CANCELED	"error":"failed to add to cart:[^"]+context canceled[^"]+"
ERROR_FULL_CART_RETRIEVE_CONNECTION_REFUSED	"error":"could not retrieve cart: rpc error: code = Unavailable desc = connection error: desc = \\"transport: Error while dialing dial tcp [^:]+:\d+: connect: connection refused\\""
ERROR_FULL_CART_ADD_CONNECTION_REFUSED	"error":"failed to add to cart: rpc error: code = Unavailable desc = connection error: desc = \\"transport: Error while dialing dial tcp [^:]+:\d+: connect: connection refused\\""
ERROR_FULL_PRODUCT_RETRIEVE_CANCELED	"error":"could not retrieve product: rpc error: code = Canceled desc = context canceled"
ERROR_FULL_SHIPPING_QUOTE_CANCELED	"error":"failed to get shipping quote: rpc error: code = Canceled desc = context canceled"
ERROR_FULL_ORDER_COMPLETE_CANCELED	"error":"failed to complete the order: rpc error: code = Canceled desc = context canceled"
ERROR_FULL_ADS_GET_DEADLINE_EXCEEDED	"error":"failed to get ads: rpc error: code = DeadlineExceeded desc = context deadline exceeded"
MESSAGE_REQUEST_ERROR_SEVERITY_ERROR	"message":"request error","session":"[^"]+","severity":"error"
MESSAGE_ADS_RETRIEVAL_FAILED_SEVERITY_WARNING	"message":"failed to retrieve ads","session":"[^"]+","severity":"warning"
ERROR_PREFIX_CART_RETRIEVE	"error":"could not retrieve cart:
ERROR_PREFIX_CART_ADD	"error":"failed to add to cart:
ERROR_PREFIX_PRODUCT_RETRIEVE	"error":"could not retrieve product:
ERROR_PREFIX_SHIPPING_QUOTE	"error":"failed to get shipping quote:
ERROR_PREFIX_RECOMMENDATION	"error":"failed to get product recommendations:
ERROR_PREFIX_ADS_GET	"error":"failed to get ads:
ERROR_PREFIX_ADS_RETRIEVE	"error":"failed to retrieve ads:
ERROR_PREFIX_ORDER_COMPLETE	"error":"failed to complete the order:
ERROR_PREFIX_ORDER_PREPARE	"error":"failed to prepare order:
ERROR_PREFIX_ORDER_CONFIRMATION	"error":"failed to send order confirmation:
ERROR_PREFIX_CART_FAILURE	"error":"cart failure:
ERROR_PREFIX_SHIPPING_FAILURE	"error":"shipping quote failure:
ERROR_PREFIX_PAYMENT_FAILURE	"error":"failed to charge card:
ERROR_PREFIX_SHIPMENT_FAILURE	"error":"shipment failed:
HTTP_POST_CART	"http.req.method":"POST","http.req.path":"/cart"
HTTP_GET_CART	"http.req.method":"GET","http.req.path":"/cart"
HTTP_GET_ROOT	"http.req.method":"GET","http.req.path":"/"
HTTP_GET_PRODUCT_DETAIL	"http.req.method":"GET","http.req.path":"/product/[A-Z0-9]+"
HTTP_POST_CHECKOUT	"http.req.method":"POST","http.req.path":"/cart/checkout"
CONTEXT_ADS_FAILURE	failed to get ads:
CONTEXT_ADS_RETRIEVE_FAILURE	failed to retrieve ads:
CONTEXT_RECOMMENDATION_FAILURE	failed to get product recommendations:
CONTEXT_RECOMMENDATION_INFO_FAILURE	failed to get recommended product info:
CONTEXT_ORDER_FAILURE	failed to complete the order:
CONTEXT_CART_ADD_FAILURE	failed to add to cart:
CONTEXT_CART_RETRIEVE_FAILURE	could not retrieve cart:
CONTEXT_SHIPPING_FAILURE	shipping quote failure:
CONTEXT_SHIPPING_QUOTE_FAILURE	failed to get shipping quote:
CONTEXT_CART_FAILURE	cart failure:
CONTEXT_EMAIL_FAILURE	failed to send order confirmation:
CONTEXT_ORDER_PREPARATION_FAILURE	failed to prepare order:
CONTEXT_PRODUCT_RETRIEVE_FAILURE	could not retrieve product:
CONTEXT_PAYMENT_FAILURE	failed to charge card:
CONTEXT_SHIPMENT_FAILURE	shipment failed:
ERROR_UNAVAILABLE_CONNECTION_REFUSED_DETAILED	code = Unavailable desc = connection error: desc = \"transport: Error while dialing dial tcp [^:]+:\d+: connect: connection refused\"
ERROR_UNAVAILABLE_TIMEOUT_DETAILED	code = Unavailable desc = connection error: desc = \"transport: Error while dialing dial tcp [^:]+:\d+: i/o timeout\"
ERROR_UNAVAILABLE_CONNECTION	code = Unavailable desc = connection error
ERROR_UNAVAILABLE_TRANSPORT_CLOSING	code = Unavailable desc = transport is closing
ERROR_UNAVAILABLE_TIMEOUT	code = Unavailable desc = timed out
ERROR_UNAVAILABLE	code = Unavailable
ERROR_FAILED_PRECONDITION_CART_STORAGE	code = FailedPrecondition desc = Can't access cart storage
ERROR_FAILED_PRECONDITION	code = FailedPrecondition
ERROR_INTERNAL_SHIPPING	code = Internal desc = shipping quote failure
ERROR_INTERNAL_PAYMENT	code = Internal desc = failed to charge card
ERROR_INTERNAL_ORDER_PREP	code = Internal desc = failed to prepare order
ERROR_INTERNAL	code = Internal
ERROR_DEADLINE_EXCEEDED	code = DeadlineExceeded desc = context deadline exceeded
ERROR_TIMEOUT	code = DeadlineExceeded
ERROR_CANCELED_CONTEXT	code = Canceled desc = context canceled
ERROR_CANCELED	code = Canceled
ERROR_UNKNOWN_EXCEPTION	code = Unknown desc = Exception calling application
ERROR_UNKNOWN_EMPTY	code = Unknown desc = 
ERROR_UNKNOWN	code = Unknown
EXCEPTION_CONNECTION_REFUSED_DETAILED	connection error: desc = "transport: Error while dialing dial tcp [^:]+:\d+: connect: connection refused"
EXCEPTION_TIMEOUT_DETAILED	connection error: desc = "transport: Error while dialing dial tcp [^:]+:\d+: i/o timeout"
EXCEPTION_CONNECTION_REFUSED	connection refused
EXCEPTION_TIMEOUT	i/o timeout
EXCEPTION_HANDSHAKE_TIMEOUT	timed out waiting for server handshake
EXCEPTION_TIMEOUT	timed out waiting
EXCEPTION_CANCELED	context canceled
EXCEPTION_TRANSPORT_CLOSING	transport is closing
EXCEPTION_CONNECTION_RESET	Connection reset by peer
EXCEPTION_REDIS_TIMEOUT	RedisTimeoutException
EXCEPTION_REDIS_CONNECTION	RedisConnectionException
EXCEPTION_SOCKET_FAILURE	SocketFailure
CART_SERVICE	cartservice[\w.-]*
REDIS_ENDPOINT	redis-cart:\d+
INTERNAL_IP_PORT	10\.233\.\d+\.\d+:\d+
PATH_CHECKOUT	"/cart/checkout"
PATH_CART	"/cart"
PATH_PRODUCT_DETAIL	"/product/[A-Z0-9]+"
PATH_ROOT	"/"
PATH_OTHER	"/[\w/]+"
METHOD_GET	"GET"
METHOD_POST	"POST"
CART_STACK_TRACE	at cartservice\.cartstore\.RedisCartStore\.[\w]+\([^)]*\) in
REDIS_STACK_TRACE	at StackExchange\.Redis\.[\w.]+\([^)]*\) in
IO_STACK_TRACE	at System\.IO\.Pipelines\.[\w.]+\([^)]*\)
STACK_TRACE	at [\w.]+\.[\w.]+\([^)]*\) in
CS_FILE_LINE	/[\w/]+\.cs:line \d+
PRODUCT_ID	#[A-Z0-9]{10}
PRODUCT_CODE	[A-Z0-9]{10}
MESSAGE_REQUEST_ERROR	"message":"request error"
MESSAGE_ADS_RETRIEVAL_FAILED	"message":"failed to retrieve ads"
SEVERITY_ERROR	"severity":"error"
SEVERITY_WARNING	"severity":"warning"
ISO_TIMESTAMP	\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z
URL	http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:[0-9a-fA-F][0-9a-fA-F]))+
HOST	\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}
UID	\w{8}-\w{4}-\w{4}-\w{4}-\w{12}
'''


def mask_rules() -> list[tuple[str, str]]:
    """The (mask name, pattern) pairs in the order they must be applied."""
    lines = RULE_TEXT.strip("\n").split("\n")
    return [tuple(line.split("\t", 1)) for line in lines]
